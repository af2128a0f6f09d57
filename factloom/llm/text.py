"""Column expressions on texts that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, the separators of words.
SPACE = r"[ \t-\r]+"


def words(text: Column) -> Column:
    """The runs without ASCII white space; an empty array for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def excerpt(text: Column, first: Column, n: Column) -> Column:
    """``n`` words from number ``first`` (from 0) on, with the white space between them."""
    gaps = F.slice(F.split(text, r"[^ \t-\r]+", -1), (first + 2).cast("int"), F.greatest(n - 1, F.lit(0)).cast("int"))
    return F.array_join(F.zip_with(F.slice(words(text), (first + 1).cast("int"), n.cast("int")), F.concat(gaps, F.array(F.lit(""))), lambda w, g: F.concat(w, g)), "")


def array_sum(values: Column, kind: str = "long") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: a + x.cast(kind))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, op: Callable[[Column, Column], Column], bunch: int = 256) -> Column:
    """For every value of an array of longs, op over all up to it; op is associative, like a sum or F.greatest.

    Arrays are copied when they grow, so that one long fold would be quadratic:
    bunches are folded on their own, then what stands before each is added.
    """
    kind = "array<bigint>"
    zero = F.struct(F.lit(None).cast("bigint").alias("at"), F.array().cast(kind).alias("out"))

    def step(a: Column, x: Column) -> Column:
        return let(F.when(a["at"].isNull(), x).otherwise(op(a["at"], x)), lambda v: F.struct(v.alias("at"), F.concat(a["out"], F.array(v)).alias("out")))

    fold = lambda xs: F.aggregate(xs, zero, step, lambda a: a["out"])
    bunches = lambda v: F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / bunch).cast("int")), lambda i: fold(F.slice(v, i * bunch + 1, F.lit(bunch))))
    after = lambda parts: fold(F.transform(parts, lambda p: F.element_at(p, -1)))
    joined = lambda parts: let(after(parts), lambda ends: F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda x: op(F.get(ends, i - 1), x))))))
    return let(values, lambda v: F.when(F.size(v) > 0, let(bunches(v), joined)).otherwise(F.array().cast(kind)))


def rows_of(df: DataFrame) -> DataFrame:
    """The rows as one column, row, so that no name of theirs meets one of ours."""
    return df.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("row"))


def field_of(c: str) -> Column:
    return F.col("row").getField(c)


def fenced(df: DataFrame) -> DataFrame:
    """The same rows; no filter is pushed below, where it would compute costly columns again for every mention."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))
