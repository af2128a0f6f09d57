"""Payloads held against a schema that is a table of paths.

A payload becomes rows of paths and kinds, as deep as the schema asks; what is
required and absent is an anti-join, what is there and wrong a join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import variants
from factloom.scratch import Scratch


@dataclass(frozen=True)
class Rule:
    """What a path must be. ``path`` has ``[]`` for any item of an array: ``claims[].severity``.

    Messages may name the field, ``{field}``, and its place, ``{at}``. ``allowed``
    values are compared as trimmed lower-case text; ``absent`` counts for NULL too if
    there are any.
    """

    path: str
    kind: str | None = None
    allowed: tuple[str, ...] | None = None
    absent: str | None = None
    wrong: str | None = None


# The fields of a verification response, and what is said of their flaws.
LIST_FIELDS = ("unsupported_claims", "weak_claims", "missing_uncertainty", "missing_factual_support", "supported_claims_sample", "recommended_fixes")
VERIFICATION = tuple(
    rule for f in LIST_FIELDS for rule in (
        Rule(f, "array", absent="Missing expected field: {field}.", wrong="Expected field to be a list: {field}."), Rule(f"{f}[]", "object", wrong="Expected {at} to be an object."),
    )
) + (
    Rule("verdict", allowed=("pass", "warning", "fail"), absent="Missing or invalid verdict.", wrong="Missing or invalid verdict."),
    Rule("unsupported_claims[].severity", allowed=("high", "medium", "low"), absent="Unsupported claim severity must be high, medium, or low.", wrong="Unsupported claim severity must be high, medium, or low."),
)
NOT_PARSED = "No structured payload was parsed."


def _parent(path: str) -> str:
    return path[:-2] if path.endswith("[]") else path.rpartition(".")[0]


def payload_paths(payloads: DataFrame, rules: tuple[Rule, ...], payload: str = "payload") -> DataFrame:
    """(id, path, at, n, kind, value) of every place of a payload that the rules or their parents name; the payload itself has the path ''.

    path has ``[]`` for items, at their numbers; n is the place of the last item, or
    -1. payloads: id, and a VARIANT column.
    """
    wanted = {""}
    for r in rules:
        p = r.path
        while p:
            wanted.add(p)
            p = _parent(p)
    rows = payloads.select("id", F.lit("").alias("path"), F.lit("").alias("at"), F.lit(-1).alias("n"), F.col(payload).alias("v"))
    levels = [rows]
    while True:
        names = {p for p in wanted if p and _parent(p) in {q for q in wanted if q.count(".") + q.count("[]") + bool(q) == len(levels) - 1}}
        if not names:
            break
        dot = lambda c: F.when(F.col(c) == "", "").otherwise(F.concat(F.col(c), F.lit(".")))
        of_objects = levels[-1].select("id", dot("path").alias("p"), dot("at").alias("a"), "n", F.explode(variants.fields(F.col("v"))).alias("k", "v"))
        of_objects = of_objects.select("id", F.concat("p", "k").alias("path"), F.concat("a", "k").alias("at"), "n", "v")
        of_arrays = levels[-1].select("id", F.concat("path", F.lit("[]")).alias("path"), "at", F.posexplode(variants.items(F.col("v"))).alias("i", "v"))
        of_arrays = of_arrays.select("id", "path", F.concat_ws("", "at", F.lit("["), F.col("i").cast("string"), F.lit("]")).alias("at"), F.col("i").alias("n"), "v")
        levels.append(of_objects.unionByName(of_arrays).filter(F.col("path").isin(sorted(names))))
    every = reduce(DataFrame.unionByName, levels)
    value = F.when(~variants.kind(F.col("v")).isin("object", "array"), variants.shown(F.col("v")))
    return every.select("id", "path", "at", "n", variants.kind(F.col("v")).alias("kind"), value.alias("value"))


def _said(message: Column, path: Column, at: Column) -> Column:
    return F.replace(F.replace(message, F.lit("{field}"), path), F.lit("{at}"), at)


def schema_errors(payloads: DataFrame, rules: tuple[Rule, ...] = VERIFICATION, payload: str = "payload") -> DataFrame:
    """(id, errors): what is wrong with each payload, in the order of the rules and of items; empty for none.

    payloads: id, each once, and a VARIANT column. A payload that is NULL or no
    object has the one error that there is none.
    """
    spark = payloads.sparkSession
    table = spark.createDataFrame([(i, r.path, _parent(r.path), r.kind, list(r.allowed) if r.allowed else None, r.absent, r.wrong) for i, r in enumerate(rules)], "rank int, path string, parent string, want string, allowed array<string>, absent string, wrong string")
    table = F.broadcast(table)  # as many rows as there are rules
    found = Scratch(spark, "paths").table(payload_paths(payloads, rules, payload))
    there = found.join(table, "path")
    badly = F.col("want").isNotNull() & (F.col("kind") != F.col("want"))
    foreign = F.col("allowed").isNotNull() & ~F.coalesce(F.array_contains("allowed", F.lower(F.trim("value"))), F.lit(False))
    wrong = there.filter(badly | foreign).select("id", "rank", "n", _said(F.col("wrong"), F.col("path"), F.col("at")).alias("message"))
    holders = found.filter("kind = 'object'").select("id", F.col("path").alias("parent"), F.col("at").alias("in"), "n")
    field = F.regexp_extract("path", r"[^.]*$", 0)
    due = holders.join(table.filter("absent is not null"), "parent").withColumn("at", F.when(F.col("in") == "", field).otherwise(F.concat_ws(".", "in", field)))
    absent = due.join(found.select("id", "at"), ["id", "at"], "left_anti").select("id", "rank", "n", _said(F.col("absent"), F.col("path"), F.col("at")).alias("message"))
    # a message for each place; a scalar has one flaw
    listed = wrong.unionByName(absent).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "n", "message"))), lambda x: x["message"]).alias("errors"))
    parsed = payloads.select("id", F.coalesce(variants.kind(F.col(payload)) == "object", F.lit(False)).alias("_object"))
    nothing = F.array().cast("array<string>")
    return parsed.join(listed, "id", "left").select("id", F.when(~F.col("_object"), F.array(F.lit(NOT_PARSED))).otherwise(F.coalesce("errors", nothing)).alias("errors"))
