"""One-row summaries of fact tables, and counts of what they hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(rows: DataFrame, column: str, unknown: str | None = None) -> DataFrame:
    c = F.col(column) if unknown is None else F.coalesce(F.col(column), F.lit(unknown))
    return rows.groupBy(c.alias(column)).agg(F.count("*").alias("n"))


def conditional_counts(rows: DataFrame, **tests: Column) -> DataFrame:
    return rows.agg(*[F.count_if(t).alias(n) for n, t in tests.items()])


def analysis_summary(inventory: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of files by type, of entities and imports, and the languages in use. Three one-row tables side by side."""
    files = inventory.agg(
        F.count("*").alias("file_count"), *[F.count_if(F.col("file_type") == t).alias(f"{t}_file_count") for t in ("source", "test", "config")],
        F.count_if(F.col("analysis_depth") == "deep").alias("deep_analyzed_file_count"), F.sort_array(F.collect_set(F.when(F.col("language") != "unknown", F.col("language")))).alias("detected_languages"),
    )
    return files.join(entities.agg(F.count("*").alias("entity_count"))).join(edges.agg(F.count("*").alias("import_count")))


def coverage(inventory: DataFrame, entities: DataFrame, edges: DataFrame, supported: tuple[str, ...]) -> DataFrame:
    deep = F.col("analysis_depth") == "deep"
    files = inventory.agg(
        F.count("*").alias("indexed_file_count"), F.count_if(deep).alias("deep_analyzed_file_count"), F.count_if(~deep).alias("shallow_indexed_file_count"),
        F.sort_array(F.collect_set(F.when(~F.col("language").isin(*supported), F.col("extension")))).alias("unsupported_deep_extensions"),
    )
    return files.join(edges.agg(F.count_if(F.col("dependency_type") == "unresolved").alias("unresolved_import_count"))).join(entities.agg(F.count_if(F.col("confidence") == "low").alias("low_confidence_entity_count")))


def record_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(artifact, record_count)."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("record_count")).select(F.lit(n).alias("artifact"), "record_count") for n, df in tables.items()])


def warnings(counts: DataFrame, column: str, text: str) -> DataFrame:
    """A sentence with the number, where it isn't 0."""
    return counts.withColumn("warning", F.when(F.col(column) > 0, F.format_string(text, F.col(column))))


def internal_edges_within(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges with both ends among the files."""
    return edges.join(files.select(F.col("file").alias("source_file")), "source_file", "left_semi").join(files.select(F.col("file").alias("resolved_file")), "resolved_file", "left_semi")


def latest_time(*tables: DataFrame, column: str = "generated_at") -> DataFrame:
    return reduce(DataFrame.union, [t.select(column) for t in tables]).agg(F.max(column).alias(column))


def limitations(found: Column, always: tuple[str, ...]) -> Column:
    return F.array_sort(F.array_distinct(F.concat(found, F.array(*[F.lit(x) for x in always]))))
