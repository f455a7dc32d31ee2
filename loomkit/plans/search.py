"""Ranked search and help over function docs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights of a hit by field (fixed values).
WEIGHTS = {"function": 10, "tags": 5, "summary": 3, "description": 1}


def search(docs: DataFrame, query: str) -> DataFrame:
    """Docs with a score: for each word of the query the weights of the fields that contain it, case aside. Best first; no hit, no row."""
    score = F.lit(0)
    for word in query.lower().split():
        for field, weight in WEIGHTS.items():
            score = score + F.when(F.contains(F.lower(F.coalesce(field, F.lit(""))), F.lit(word)), weight).otherwise(0)
    found = docs.select("module", "function", "summary", score.cast("long").alias("score")).where("score > 0")
    return found.orderBy(F.desc("score"), "module", "function")


def help_text(docs: DataFrame, name: str) -> str | None:
    """Markdown for a function, or for all of a module, however many there are; None if there is neither."""
    rows = docs.where((F.col("function") == name) | (F.col("module") == name)).orderBy("module", "function").toLocalIterator()
    parts = []
    for r in rows:
        body = [f"## {r.signature}", r.summary, r.description, f"### Example\n\n```sql\n{r.example}\n```" if r.example else None]
        parts.append("\n\n".join(p for p in body if p))
    return "\n\n".join(parts) or None
