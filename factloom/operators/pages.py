"""Markdown tables and lists of pages, built by aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import cell


def table_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.array(*[F.coalesce(cell(c.cast("string")), F.lit("no data")) for c in cells]), " | "), F.lit(" |"))


def markdown_table(rows: DataFrame, by: list[str], columns: list[str], order: list[str], name: str = "page") -> DataFrame:
    """One table per group, rows in order."""
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns)
    lines = rows.select(*by, *order, table_row(*[F.col(c) for c in columns]).alias("_line")) if not set(by) & set(order) else rows.select(*dict.fromkeys([*by, *order]), table_row(*[F.col(c) for c in columns]).alias("_line"))
    body = lines.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, "_line"))).alias("_b"))
    return body.select(*by, F.concat(F.lit(head + "\n"), F.array_join(F.transform("_b", lambda x: x["_line"]), "\n")).alias(name))


def parameter_text(parameters: Column) -> Column:
    """name: annotation = default, joined."""
    one = lambda p: F.concat(p["name"], F.coalesce(F.concat(F.lit(": "), p["annotation"]), F.lit("")), F.coalesce(F.concat(F.lit(" = "), p["default"]), F.lit("")))
    return F.array_join(F.transform(parameters, one), ", ")


def key_files(modules: DataFrame, categories: list[str]) -> DataFrame:
    """(name, category, file) from one array column per category."""
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("files")) for c in categories])
    return modules.select("name", F.inline(rows)).select("name", "category", F.explode("files").alias("file"))


def file_counts(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, entity_count, import_count) of files with either."""
    e = entities.groupBy("file").agg(F.count("*").alias("entity_count"))
    i = edges.groupBy(F.col("source_file").alias("file")).agg(F.count("*").alias("import_count"))
    zero = F.lit(0).cast("long")
    return e.join(i, "file", "full").select("file", F.coalesce("entity_count", zero).alias("entity_count"), F.coalesce("import_count", zero).alias("import_count"))

