"""Search over records of many kinds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT = ("title", "subtitle", "entity_id", "module_name", "path", "search_text")
FACETS = ("kind", "verdict", "type", "role", "severity", "run_kind", "run_id")
COLUMNS = {"kind": "entity_kind", "verdict": "verification_verdict"}


def records(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
    """Search rows: the given columns, the others NULL."""
    names = ["entity_id", "title", "subtitle", "module_name", "path", "search_text", "verification_verdict", "type", "problem_type", "role", "severity", "run_kind", "run_id"]
    return df.select(F.lit(kind).alias("entity_kind"), *[columns.get(n, F.lit(None)).cast("string").alias(n) for n in names])


def index(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def search(rows: DataFrame, q: str | None = None, **facets: str) -> DataFrame:
    """Rows that hold q in any text column, whatever its case, and meet every facet; rank 0 for an equal title, 1 for one that holds q, else 2."""
    query = (q or "").strip().lower()
    if query:
        rows = rows.filter(F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in TEXT])).contains(query))
    for name, value in facets.items():
        if name not in FACETS:
            raise ValueError(f"no such facet: {name}")
        test = (F.col("type") == value) | (F.col("problem_type") == value) if name == "type" else F.col(COLUMNS.get(name, name)) == value
        rows = rows.filter(F.coalesce(test, F.lit(False)))
    title = F.lower(F.coalesce("title", F.lit("")))
    rank = F.when(title == query, 0).when(title.contains(query), 1).otherwise(2) if query else F.lit(2)
    return rows.withColumn("rank", rank)


def ranked(rows: DataFrame) -> DataFrame:
    return rows.orderBy("rank", "entity_kind", "title", "entity_id")
