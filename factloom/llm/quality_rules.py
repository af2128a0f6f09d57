"""Quality rules with risk-controlled cutoffs, in DataFrame operations only.

Each document gets signals (shares of symbols, repeated lines and repeated
words, mean word length, number of words). Each rule has a ladder of cutoffs,
from lenient to strict. On the labelled good documents of a stratum a cutoff is
admissible if the exact binomial bound says that it rejects at most the rule's
share of ``alpha`` of good documents: P(Bin(n, alpha / rules) <= k) <= delta /
(strata * rules), k being the good documents it rejects. The ladder is walked
from its lenient end to the first cutoff that isn't admissible (fixed-sequence
testing), and Bonferroni over strata and rules corrects for the many tests: with
probability 1 - delta no stratum loses more than ``alpha`` of its good documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.scratch import Scratch, broadcast_if_small

from .text import fenced, field_of, rows_of, words

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Reject where ``signal > cutoff``; ``ladder`` falls from lenient to strict."""

    name: str
    signal: str
    ladder: tuple[float, ...]


def _falling(top: float, bottom: float, steps: int) -> tuple[float, ...]:
    return tuple(round(top * (bottom / top) ** (i / (steps - 1)), 6) for i in range(steps))


RULES = (
    Rule("symbols", "n_symbols / greatest(word_chars, 1)", _falling(0.5, 0.005, 24)),
    Rule("dup_lines", "n_dup_lines / greatest(n_lines, 1)", _falling(0.9, 0.1, 24)),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", _falling(0.9, 0.1, 24)),
    Rule("long_words", "word_chars / greatest(n_words, 1)", _falling(40.0, 8.0, 24)),
    Rule("short_words", "-(word_chars / greatest(n_words, 1))", tuple(-x for x in reversed(_falling(4.0, 1.0, 24)))),
    Rule("short", "-n_words", tuple(-float(50 + 5 * i) for i in range(24))),
)


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """The measured columns in place of the text; NULL counts as a text without words.

    The repeated words of a text are those in three-word windows whose hash (64
    bits over the three words) occurs twice or more in it; windows are sorted
    only in texts that repeat one.
    """
    base = docs.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumn("_w", words(F.col("_text")))
    w, n = F.col("_w"), F.size("_w")
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    base = base.select(
        *docs.columns,
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
        .otherwise(F.array().cast("array<bigint>"))
        .alias("_h"),
    )
    base = base.withColumn("n_lines", F.size("_lines").cast("long")).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    base = base.withColumn("_s", F.when(repeats, F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("_h")
    s, m = F.col("_s"), F.size("_s")

    def same(j: Column, k: Column) -> Column:
        return F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))

    twice = F.filter(F.sequence(F.lit(0), m - 1), lambda j: same(j, j + 1) | ((j > 0) & same(j, F.greatest(j - 1, F.lit(0)))))
    at = F.sort_array(F.transform(twice, lambda j: F.get(s, j)["i"]))
    covered = F.aggregate(
        at,
        F.struct(F.lit(-3).alias("p"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("p"), (a["n"] + F.least(F.lit(3), p - a["p"])).alias("n")),
        lambda a: a["n"],
    )
    return fenced(base.withColumn("n_repeat_words", F.when(s.isNotNull(), covered).otherwise(F.lit(0).cast("long"))).drop("_s", text))


def _log_gamma(z: str) -> str:
    """ln gamma of z >= 1: Stirling's series eight steps up, less the steps."""
    steps = " + ".join(f"ln({z} + {i})" for i in range(8))
    x = f"({z} + 8)"
    return f"(({x} - 0.5) * ln({x}) - {x} + 0.918938533204672742 + 1 / (12 * {x}) - 1 / (360 * pow({x}, 3)) + 1 / (1260 * pow({x}, 5)) - ({steps}))"


def binomial_cdf(n: str, k: str, p: float) -> Column:
    """P(Bin(n, p) <= k) for k <= n * p, NULL beyond; terms under 1e-40 of the largest are left out."""
    top = f"({_log_gamma(f'({n} + 1D)')} - {_log_gamma(f'({k} + 1D)')} - {_log_gamma(f'({n} - {k} + 1D)')} + {k} * ln({p}D) + ({n} - {k}) * ln(1 - {p}D))"
    terms = f"cast(least({k}, ceil(14 * sqrt({n} * {p}D * (1 - {p}D))) + 60) as int)"
    total = (
        f"aggregate(sequence(0, {terms}), named_struct('t', 1D, 's', 0D),"
        f" (a, i) -> named_struct('t', a.t * ({k} - i) / greatest({n} - {k} + i + 1, 1) * {(1 - p) / p!r}D, 's', a.s + a.t), a -> a.s)"
    )
    return F.expr(f"case when {k} <= {n} * {p}D then least(1D, exp({top}) * {total}) end")


def choose_cutoffs(measured: DataFrame, stratum: str, good: str, alpha: float, delta: float, rules: tuple[Rule, ...] = RULES, strata: int | None = None) -> DataFrame:
    """(stratum, rule, cutoff, n_good, n_rejected, bound) of the strictest admissible cutoff; no row where none is."""
    held = measured.filter(F.col(good)).select(F.col(stratum).alias("stratum"), *[F.expr(f"cast({r.signal} as double)").alias(r.name) for r in rules])
    strata = strata if strata is not None else held.select("stratum").distinct().count()
    share, level = alpha / len(rules), delta / max(1, strata * len(rules))
    def first(r: Rule) -> Column:
        """The ladder's first step that rejects a document, or its length."""
        return F.size(F.filter(F.array(*[F.lit(float(c)) for c in r.ladder]), lambda c: F.col(r.name) <= c))

    steps = held.select("stratum", F.explode(F.map_from_arrays(F.array(*[F.lit(r.name) for r in rules]), F.array(*[first(r) for r in rules]))).alias("rule", "step"))
    counted = steps.groupBy("stratum", "rule", "step").count()
    ladder = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.array(*[F.lit(float(c)) for c in r.ladder]).alias("ladder")) for r in rules])
    per = counted.groupBy("stratum", "rule").agg(F.sum("count").alias("n"), F.map_from_entries(F.collect_list(F.struct("step", "count"))).alias("at"))
    per = per.withColumn("ladder", F.filter(ladder, lambda x: x["rule"] == F.col("rule"))[0]["ladder"])
    each = per.select("stratum", "rule", "n", "at", F.posexplode("ladder").alias("step", "cutoff"))
    each = each.withColumn("k", F.aggregate(F.sequence(F.lit(0), F.col("step")), F.lit(0).cast("long"), lambda a, i: a + F.coalesce(F.col("at")[i], F.lit(0))))
    each = each.withColumn("bound", binomial_cdf("n", "k", share)).withColumn("ok", F.coalesce(F.col("bound") <= level, F.lit(False)))
    walk = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("ok", F.min("ok").over(walk)).filter("ok")
    return each.groupBy("stratum", "rule").agg(
        F.max_by("cutoff", "step").alias("cutoff"), F.max("n").alias("n_good"), F.max_by("k", "step").alias("n_rejected"), F.max_by("bound", "step").alias("bound")
    )


def _measured(docs: DataFrame, min_words: int, max_repeat_percent: int) -> DataFrame:
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return signals(docs).withColumn("base_failed", base)


def _fit(feats: DataFrame, labels: DataFrame, alpha: float, delta: float, rules: tuple[Rule, ...], scratch: Scratch) -> DataFrame:
    marks = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    held = scratch.table(feats.join(marks.filter("good"), "doc_id").filter(~F.col("base_failed")))
    cut = scratch.table(choose_cutoffs(held, "stratum", "good", alpha, delta, rules))
    scratch.drop(held)
    return cut


def _judged(feats: DataFrame, cut: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Adds rejected_by to measured rows with a stratum; cutoffs are few and broadcast, or joined by shuffle beyond 10,000 rows."""
    wide = cut.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"cut_{r.name}") for r in rules])
    wide = broadcast_if_small(wide.withColumnRenamed("stratum", "_stratum"), cut.count())
    scored = feats.join(wide, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    failed = F.array_compact(F.array(*[F.when(F.expr(f"cast({r.signal} as double)") > F.col(f"cut_{r.name}"), F.lit(r.name)) for r in rules]))
    return scored.withColumn("rejected_by", F.when(F.col("base_failed"), F.array(F.lit("base"))).otherwise(failed))


def keep_good(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05, rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """The documents' rows, all columns, that apply_rules keeps. Texts are measured twice and never shuffled."""
    scratch = Scratch(docs.sparkSession, "quality")
    cut = _fit(_measured(docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), "text"), min_words, max_repeat_percent), labels, alpha, delta, rules, scratch)
    rows = rows_of(docs).select("row", field_of(stratum).cast("string").alias("stratum"), field_of("text").alias("text"))
    return _judged(_measured(rows, min_words, max_repeat_percent), cut, rules).filter(F.size("rejected_by") == 0).select("row.*")


def apply_rules(
    docs: DataFrame,
    labels: DataFrame,
    *,
    stratum: str = "lang",
    alpha: float = 0.02,
    delta: float = 0.05,
    rules: tuple[Rule, ...] = RULES,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """One row per document: doc_id, signals, base_failed, rejected_by, kept.

    docs: doc_id, text and the stratum column; labels: doc_id, quality (1 good).
    Only these columns are read, so others may have any name. Defined results: a
    NULL or empty text has no words and fails the base rules; a NULL stratum is a
    stratum of its own; a document without label, or with contradicting labels
    (the worst counts), doesn't loosen a cutoff; repeated rows give repeated
    results; an empty table gives an empty result; a stratum with too few good
    labelled documents gets no cutoff, so that only the base rules act there.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    feats = scratch.table(_measured(docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), "text"), min_words, max_repeat_percent))
    cut = _fit(feats, labels, alpha, delta, rules, scratch)
    return _judged(feats, cut, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (F.size("rejected_by") == 0).alias("kept"), F.array_join("rejected_by", ",").alias("rejected_by")
    )
