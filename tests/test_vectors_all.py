import random

from loomkit.operators import vectors


def test_search_of_a_table_of_queries(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS", 7)
    monkeypatch.setattr(vectors, "QUERIES", 2)
    r = random.Random(4)
    rows = [(i, [float(r.randrange(4)) for _ in range(3)]) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(3)
    index = vectors.VectorIndex(df.where("v is not null"), "id", "v", 3).build()
    got = sorted((x.q, x.distance, x.id) for x in index.search_all(df.where("id % 20 = 0").selectExpr("id as q", "v"), "q", 5).collect())
    want = []
    for q, a in rows[:60:20]:
        want += [(q, d, i) for d, i in sorted((sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5, i) for i, b in rows[:60])[:5]]
    assert got == sorted(want)
