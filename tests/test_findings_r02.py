"""Cases of the findings of round 2."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomkit.llm import encode
from loomkit.operators import aggregates as A
from loomkit.operators import vectors


def test_numbered_has_the_same_ranges_for_counts_and_places(spark):
    n = 30_000  # more rows than a range partitioner draws
    df = spark.range(n).select(((F.col("id") * 7919) % n).alias("k"), F.lit("x").alias("other"))
    found = vectors.numbered(df, vectors.natural_key(F.concat(F.lit("Customer"), F.col("k").cast("string"))), "place")
    assert found.where(F.col("place") != F.col("k") + 1).count() == 0
    assert found.count() == n


def test_numbered_takes_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(None,), (3,), (None,), (1,)], "k int")
    assert sorted((r.place, r.k) for r in vectors.numbered(df, F.col("k"), "place").collect()) == [(1, None), (2, None), (3, 1), (4, 3)]
    assert vectors.numbered(df.where("k > 5"), F.col("k"), "place").count() == 0


def test_percentiles_are_spark_s_own(spark):
    x = F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 7 == 0, 5.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(10_000)) / 3.0)
    k = F.when(F.col("id") % 3 == 0, None).otherwise((F.col("id") % 3).cast("string"))
    df = spark.range(20_000).select(k.alias("k"), (F.col("id") % 2).alias("m"), x.alias("x")).unionByName(spark.sql("SELECT 'none' AS k, 5L AS m, CAST(NULL AS DOUBLE) AS x"))
    at = {"low": 0.1, "med": 0.5, "top": 1.0}
    for how in ("groupBy", "rollup", "cube"):
        want = getattr(df, how)("k", "m").agg(F.count("x").alias("n"), *(F.percentile("x", p).alias(name) for name, p in at.items()))
        got = A.percentiles(df, ["k", "m"], F.col("x"), at, [F.count("x").alias("n")], how)
        assert got.columns == want.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())), how


def test_percentiles_bring_no_group_to_one_task(spark):
    from loomkit import suite

    for name in ("hm_rollup", "approximate_events"):
        plan = suite.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert " percentile(" not in plan and "median(" not in plan, name


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_new_words_are_encoded_as_the_library_does(name):
    path = public_tokenizers.path(name)
    own, library = encode.Encoder(path), Tokenizer.from_file(path)
    words = ["Zorblinth", "zorblinth", "zorblinth.", "it's", "naïve", "x1y2", "<|endoftext|>", "a\x7fb", "don't,", "ﬁn", "中文", "q", "'s", "~", "."]
    texts = words + [" ".join(words), "\n".join(words), "zorblinth\nZorblinth it's\n'tis\n.\nnaïve 'll", "\nq", "q\n", "q\n\nq", "q \nq", "q\n q", "q  q", "q\tq\nq", "", "\n", " q"]
    for text in texts * 2:  # new, then remembered
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_a_new_plain_word_is_one_pre_token_without_a_search():
    own = encode.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    own.pattern = None  # the search costs more than the model on words that are seen once
    assert own.encode("zorblinth Grumvex\nblarkot")
