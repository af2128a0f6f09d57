"""Cuts of context documents with a ledger from which they can be made again, and proved.

A cut is recorded with how long the text was and is, and the fingerprint of what is
left; a replay cuts the original anew by the ledger alone and must come to the
same fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import fingerprint, tokens_of_chars, truncated

# How many characters a context document keeps, by its path.
LIMITS = {"dependency-map.md": 6_000, "module-map.md": 4_000, "files/index.md": 2_500}
FILE_PAGE, FILE_LIMIT, MODE = "files/file-", 2_500, "char_limit"


def limit_of(path: Column) -> Column:
    """How many characters a document of this path keeps; NULL for all."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    out = F.when(plain.startswith(FILE_PAGE), FILE_LIMIT)
    for name, limit in LIMITS.items():
        out = out.when(plain == name, limit)
    return out


def _cut(text: Column, path: Column) -> Column:
    """The text as its path's limit leaves it."""
    limits = sorted({*LIMITS.values(), FILE_LIMIT})
    out = text
    for n in limits:
        out = F.when(limit_of(path) == n, truncated(text, n)).otherwise(out)
    return out


def reduced(documents: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """The documents with ``content``, what is kept of the text, and ``cut``: mode, lengths, estimates and fingerprint, NULL where all is kept."""
    rows = documents.withColumn("content", _cut(F.col(text), F.col(path)))
    was, now = F.length(text), F.length("content")
    entry = F.struct(
        F.lit(MODE).alias("truncation_mode"), was.cast("long").alias("original_chars"), now.cast("long").alias("retained_chars"), tokens_of_chars(was).alias("original_estimated_tokens"),
        tokens_of_chars(now).alias("retained_estimated_tokens"), fingerprint(F.col("content")).alias("fingerprint"),
    )
    return rows.withColumn("cut", F.when(F.col("content") != F.col(text), entry))


def replayed(originals: DataFrame, ledger: DataFrame, key: list[str], path: str = "path", text: str = "text") -> DataFrame:
    """key, content, same: each ledger row's document cut again, and whether that is what was recorded.

    ledger: key, path and cut, as ``reduced`` gave them. A recorded length that the
    path's limit doesn't give cuts at that length, or not at all if it isn't below
    the original's; a cut that its mark makes longer than the original is the
    limit's own. A document that is gone has no content and isn't the same. Rows
    without a cut have the whole text and are the same.
    """
    rows = ledger.select(*key, path, "cut").join(originals.select(*key, F.col(text).alias("_t")), key, "left")
    kept = F.col("cut.retained_chars")
    again = _cut(F.col("_t"), F.col(path))
    content = F.when(F.col("cut").isNull(), F.col("_t")).when(F.length(again) == kept, again).when(F.col("cut.original_chars") <= kept, F.col("_t")).otherwise(F.substring(again, F.lit(1), kept.cast("int")))
    rows = rows.withColumn("content", content)
    same = F.coalesce(F.when(F.col("cut").isNull(), F.col("content").isNotNull()).otherwise((F.length("_t") == F.col("cut.original_chars")) & (fingerprint(F.col("content")) == F.col("cut.fingerprint"))), F.lit(False))
    return rows.select(*key, "content", same.alias("same"))


def context_fingerprint(documents: DataFrame, key: str, pos: str, label: str, path: str = "path", content: str = "content") -> DataFrame:
    """(key, context_chars, context_fingerprint): a module's documents in order, each under its label and path, as one text. A module's documents are bounded by its plan."""
    stripped = lambda c: F.regexp_replace(c, r"\A\s+|\s+\z", "")
    entry = F.concat(F.lit("### "), F.col(label), F.lit(": "), F.col(path), F.lit("\n"), stripped(F.col(content)))
    rows = documents.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), entry.alias("t")))).alias("_d"))
    whole = stripped(F.array_join(F.transform("_d", lambda x: x["t"]), "\n\n"))
    return rows.select(key, F.length(whole).cast("long").alias("context_chars"), fingerprint(whole).alias("context_fingerprint"))
