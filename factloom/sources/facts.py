"""Readers of JSON facts, strict and lenient, and of tables in Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_strict(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON documents of a known schema; a malformed one is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_lenient(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(good rows, (path, warning) of bad documents)."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    parsed = texts.withColumn("row", F.from_json("value", schema))
    good = parsed.filter(F.col("row").isNotNull() & F.col("value").rlike(r"^\s*\{"))
    bad = parsed.join(good.select("file"), "file", "left_anti").select(F.col("file").alias("path"), F.lit("not a JSON object of the schema").alias("warning"))
    return good.select("file", "row.*"), bad


def last_by_key(rows: DataFrame, key: str, order: str = "file") -> DataFrame:
    """One row per key, from the last file; rows without key go."""
    rest = [c for c in rows.columns if c != key]
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def markdown_table(texts: DataFrame, key: str, text: str, columns: list[str]) -> DataFrame:
    """Rows of pipe tables with as many cells as columns; heads and rules are left out."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).filter(F.trim("line").rlike(r"^\|.*\|$"))
    cells = lines.withColumn("cells", F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"(?<!\\)\|"), lambda c: F.trim(c)))
    rows = cells.filter((F.size("cells") == len(columns)) & ~F.exists("cells", lambda c: c.rlike("^:?-{3,}:?$")) & (F.lower(F.get("cells", F.lit(0))) != columns[0].lower()))
    return rows.select(key, "line_no", *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def dotenv(text: str) -> dict[str, str]:
    """k=v lines; comments and lines without '=' go, quotes around a value too."""
    pairs = (line.split("=", 1) for line in text.splitlines() if "=" in line and not line.lstrip().startswith("#"))
    return {k.strip().removeprefix("export ").strip(): v.strip().strip("'\"") for k, v in pairs}
