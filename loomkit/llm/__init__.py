"""Operations for large training-data corpora, each a Spark job over a documents table."""
