"""Relations between files, tests and modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import paths


def test_relations(edges: DataFrame, inventory: DataFrame) -> DataFrame:
    """(relation_type, source, target, confidence, reason): imports from tests to sources, then unique like-named sources for tests without any."""
    flags = inventory.select("path", "is_test", "file_type")
    tests = flags.filter("is_test").select(F.col("path").alias("source"))
    sources = flags.filter("file_type = 'source'").select(F.col("path").alias("target"))
    internal = edges.filter("dependency_type = 'internal' and resolved_file is not null").select(F.col("source_file").alias("source"), F.col("resolved_file").alias("target")).distinct()
    direct = internal.join(tests, "source").join(sources, "target").select("source", "target", F.lit("high").alias("confidence"), F.lit("direct import").alias("reason"))
    alone = unique_matches(
        tests.join(direct.select("source").distinct(), "source", "left_anti").withColumn("stem", paths.normalized_stem(F.col("source"))),
        sources.withColumn("stem", paths.normalized_stem(F.col("target"))).filter(~F.col("stem").isin(*paths.GENERIC_STEMS)), ["stem"],
    ).select("source", "target", F.lit("medium").alias("confidence"), F.lit("same stem").alias("reason"))
    return direct.unionByName(alone).select(F.lit("tests").alias("relation_type"), "source", "target", "confidence", "reason")


def unique_matches(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows joined to keys that the right side holds exactly once."""
    values = [c for c in right.columns if c not in on]
    single = right.groupBy(*on).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in values]).filter("_n = 1").drop("_n")
    return left.join(single, on)


def star(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Edges (source, target) whose ends are in the two tables."""
    return edges.join(left, "source").join(right, "target")


def inverted(rows: DataFrame, array: str, key: str, name: str) -> DataFrame:
    """(item, sorted keys) from keys with arrays of items."""
    return rows.select(F.explode(array).alias(name), key).groupBy(name).agg(F.sort_array(F.collect_set(key)).alias(f"{key}s"))


def related_modules(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(module, resolved_file, modules, ambiguous): what a module's files import from files of other modules. members: module, file."""
    at = members.select(F.col("file").alias("resolved_file"), F.col("module").alias("other"))
    rows = edges.filter("resolved_file is not null").join(members.withColumnRenamed("file", "source_file"), "source_file").join(at, "resolved_file").filter("module <> other")
    out = rows.groupBy("module", "source_file", "resolved_file").agg(F.sort_array(F.collect_set("other")).alias("modules"))
    return out.withColumn("ambiguous", F.size("modules") > 1)


def membership_counts(facts: DataFrame, members: DataFrame, by: str = "file") -> DataFrame:
    """(module, n) of facts whose file is a member; members without facts count 0."""
    counts = facts.groupBy(by).agg(F.count("*").alias("_n"))
    return members.join(counts, members.file == counts[by], "left").groupBy("module").agg(F.sum(F.coalesce("_n", F.lit(0))).alias("n"))


def documented(members: DataFrame, docs: DataFrame, facts: DataFrame) -> DataFrame:
    """Members with their document; without document and facts a member is left out, with facts it is a mismatch."""
    rows = members.join(docs.select("file", "doc_path"), "file", "left").join(facts.select("file").distinct().withColumn("_has", F.lit(True)), "file", "left")
    rows = rows.filter(F.col("doc_path").isNotNull() | F.col("_has").isNotNull())
    return rows.withColumn("mismatch", F.col("doc_path").isNull()).drop("_has")


def split_by_presence(rows: DataFrame, present: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that the other table has, and the rest."""
    return rows.join(present, on, "left_semi"), rows.join(present, on, "left_anti")


def files_index(pages: DataFrame, members: DataFrame, inventory: DataFrame) -> DataFrame:
    """Pages, and member files without a page, with what the inventory says of them."""
    missing = members.select("file").distinct().join(pages.select("file"), "file", "left_anti")
    rows = pages.withColumn("has_page", F.lit(True)).unionByName(missing.withColumn("has_page", F.lit(False)), allowMissingColumns=True)
    return rows.join(inventory, rows.file == inventory.path, "left").drop("path")
