"""Windows over event streams; the same functions work on tables."""
