"""Module candidates: five families of file sets, merged by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import paths

from .graph import reachable

RANK = ("low", "medium", "high")


def rank(confidence: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in RANK]), confidence).cast("int") - 1


def merge_candidates(rows: DataFrame) -> DataFrame:
    """One row per (type, name, files): unions of reasons and warnings, the greatest confidence."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    out = rows.groupBy("type", "name", "files").agg(union("reasons"), union("warnings"), F.max(rank(F.col("confidence"))).alias("_r"))
    return out.withColumn("confidence", F.get(F.array(*[F.lit(x) for x in RANK]), F.col("_r"))).drop("_r")


def ordered(candidates: DataFrame) -> DataFrame:
    return candidates.orderBy(rank(F.col("confidence")).desc(), "type", "name", "files")


def name_clusters(inventory: DataFrame) -> DataFrame:
    """(stem, n, directories, files) of stems that several sources share, without generic ones."""
    rows = inventory.filter("file_type = 'source'").select("path", paths.normalized_stem(F.col("path")).alias("stem"), paths.parent(F.col("path")).alias("dir"))
    out = rows.groupBy("stem").agg(F.count("*").alias("n"), F.count_distinct("dir").alias("directories"), F.sort_array(F.collect_list("path")).alias("files"))
    return out.filter((F.col("n") >= 2) & ~F.col("stem").isin(*paths.GENERIC_STEMS))


def candidate_type(base: Column, fixture_share: Column, has_tests: Column) -> Column:
    """Mostly fixtures make a fixture, or a test asset where tests are among them."""
    return F.when(fixture_share >= 0.6, F.when((base == "test_target") | has_tests, "test_asset").otherwise("fixture")).otherwise(base)


def page_role(kind: Column) -> Column:
    return (
        F.when(kind == "entrypoint", "entrypoint").when(kind.isin("fixture", "test_asset", "tests", "test_target"), "test")
        .when(kind == "directory", "aggregate").when(kind.isin("package", "feature", "name_cluster"), "detailed").otherwise("unknown")
    )


def _described(members: DataFrame, inventory: DataFrame) -> DataFrame:
    """members: type, name, file → one row per candidate with counts and shares."""
    rows = members.join(inventory.select(F.col("path").alias("file"), "file_type", "is_fixture", "is_test"), "file")
    return rows.groupBy("type", "name").agg(
        F.sort_array(F.collect_set("file")).alias("files"), F.count_if(F.col("file_type") == "source").alias("sources"), F.count_if(F.col("file_type") == "test").alias("tests"),
        F.avg(F.col("is_fixture").cast("double")).alias("fixture_share"), F.max("is_test").alias("has_tests"),
    )


def build_candidates(inventory: DataFrame, edges: DataFrame, relations: DataFrame) -> DataFrame:
    """(type, name, files, sources, tests, confidence, reasons, warnings) of all five families."""
    p = F.col("path")
    links = edges.filter("dependency_type = 'internal' and resolved_file is not null").select(F.col("source_file").alias("src"), F.col("resolved_file").alias("dst"))
    reach = reachable(inventory.filter("is_possible_entrypoint").select(p.alias("seed")), links)
    entry = reach.select(F.lit("entrypoint").alias("type"), F.col("seed").alias("name"), F.col("node").alias("file"))
    packages = inventory.filter((paths.name(p) == "__init__.py") & (paths.depth(p) > 1)).select(paths.parent(p).alias("dir")).distinct()
    tree = inventory.select("path", F.explode(paths.ancestors(p)).alias("dir"))
    package = tree.join(packages, "dir").select(F.lit("package").alias("type"), F.col("dir").alias("name"), p.alias("file"))
    top = tree.filter(~F.col("dir").contains("/")).join(packages, "dir", "left_anti")
    useful = top.join(inventory.filter("file_type in ('source', 'test')").select("path"), "path").select("dir").distinct()
    directory = top.join(useful, "dir").select(F.lit("directory").alias("type"), F.col("dir").alias("name"), p.alias("file"))
    target = relations.select(F.lit("test_target").alias("type"), F.col("target").alias("name"), F.explode(F.array("target", "source")).alias("file"))
    cluster = name_clusters(inventory).select(F.lit("name_cluster").alias("type"), F.col("stem").alias("name"), F.explode("files").alias("file"))
    rows = _described(entry.unionByName(package).unionByName(directory).unionByName(target).unionByName(cluster), inventory)
    weak = relations.groupBy(F.col("target").alias("name")).agg(F.bool_and(F.col("confidence") == "high").alias("_sure")).withColumn("type", F.lit("test_target"))
    rows = rows.join(weak, ["type", "name"], "left")
    kind = F.col("type")
    confidence = (
        F.when(kind == "entrypoint", F.when(F.size("files") >= 3, "high").otherwise("medium")).when(kind == "package", F.when(F.col("sources") >= 2, "high").otherwise("medium"))
        .when(kind == "directory", F.when((F.col("sources") > 0) | (F.col("tests") > 0), "medium").otherwise("low")).when(kind == "test_target", F.when(F.col("_sure"), "high").otherwise("medium")).otherwise("low")
    )
    shown = (
        F.when(kind == "entrypoint", F.concat(F.lit("entry:"), paths.stem(F.col("name")))).when(kind == "package", paths.name(F.col("name")))
        .when(kind == "test_target", paths.normalized_stem(F.col("name"))).otherwise(F.col("name"))
    )
    reason = (
        F.when(kind == "entrypoint", F.concat(F.lit("reached from "), F.col("name"))).when(kind == "package", F.concat(F.lit("package "), F.col("name")))
        .when(kind == "directory", F.concat(F.lit("below "), F.col("name"))).when(kind == "test_target", F.concat(F.lit("tested: "), F.col("name"))).otherwise(F.concat(F.lit("shared stem "), F.col("name")))
    )
    warning = F.array_compact(F.array(
        F.when((kind == "entrypoint") & (F.size("files") <= 1), "no internal imports"), F.when((kind == "package") & (F.col("sources") <= 1), "small package"),
        F.when((kind == "directory") & (F.col("sources") <= 1), "shallow directory"), F.when((kind == "directory") & (F.col("sources") > 0) & (F.col("tests") > 0), "sources and tests"),
        F.when((kind == "test_target") & ~F.coalesce("_sure", F.lit(False)), "some relations are guesses"),
    ))
    out = rows.select(candidate_type(kind, F.col("fixture_share"), F.col("has_tests")).alias("type"), shown.alias("name"), "files", "sources", "tests", confidence.alias("confidence"), F.array(reason).alias("reasons"), warning.alias("warnings"))
    counts = out.groupBy("type", "name", "files").agg(F.max("sources").alias("sources"), F.max("tests").alias("tests"))
    return merge_candidates(out).join(counts, ["type", "name", "files"])
