"""Runs of a batch: totals, history, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import verdict, verdict_direction

# What a comparison looks at.
GENERATION_FIELDS = ("status", "cache_hit", "context_fingerprint", "cache_key", "output_path", "metadata_path", "error", "estimated_input_tokens")
VERIFICATION_FIELDS = (
    "status", "verifier_status", "structured_output_valid", "verdict", "cache_hit", "verification_cache_key", "context_fingerprint",
    "enhanced_markdown_fingerprint", "error",
)
ISSUE_COUNTS = ("weak_claims_count", "unsupported_claims_count", "missing_factual_support_count", "missing_uncertainty_count")
USAGE = ("prompt_tokens", "completion_tokens", "total_tokens")


def diff_runs(before: DataFrame, after: DataFrame, key: str, fields: list[str], numbers: list[str] = ()) -> DataFrame:
    """Full outer comparison by key: change_status, changed_fields, and the change of each number (NULL counts 0).

    NULLs are equal to each other; of rows with one key the last by all fields wins.
    """
    def side(df: DataFrame, mark: str) -> DataFrame:
        names = [c for c in dict.fromkeys([*fields, *numbers])]
        return df.groupBy(key).agg(F.max(F.struct(*names)).alias(mark))

    both = side(before, "_a").join(side(after, "_b"), key, "full")
    a, b = F.col("_a"), F.col("_b")
    zero = F.lit(0)
    changed = F.array_compact(F.array(*[F.when(~a[f].eqNullSafe(b[f]), F.lit(f)) for f in fields], *[F.when(F.coalesce(a[n], zero) != F.coalesce(b[n], zero), F.lit(f"usage.{n}")) for n in numbers if n not in fields]))
    changed = F.when(a.isNull(), F.array(F.lit("module_added"))).when(b.isNull(), F.array(F.lit("module_removed"))).otherwise(changed)
    status = F.when(a.isNull(), "added").when(b.isNull(), "removed").when(F.size(changed) > 0, "changed").otherwise("unchanged")
    return both.select(
        key, status.alias("change_status"), changed.alias("changed_fields"), *[F.col(f"_a.{f}").alias(f"{f}_a") for f in fields], *[F.col(f"_b.{f}").alias(f"{f}_b") for f in fields],
        *[(F.coalesce(b[n], zero) - F.coalesce(a[n], zero)).alias(f"{n}_delta") for n in numbers],
    )


def diff_verifications(before: DataFrame, after: DataFrame, key: str = "module", fields: tuple[str, ...] = VERIFICATION_FIELDS) -> DataFrame:
    out = diff_runs(before, after, key, list(fields), [*ISSUE_COUNTS, *USAGE])
    a, b = verdict(F.col("verdict_a")), verdict(F.col("verdict_b"))
    return out.withColumn("verdict_a", a).withColumn("verdict_b", b).withColumn("verdict_direction", verdict_direction(F.col("verdict_a"), F.col("verdict_b")))


def change_counts(diff: DataFrame) -> DataFrame:
    return diff.agg(*[F.count_if(F.col("change_status") == s).alias(f"modules_{s}_count") for s in ("added", "removed", "changed", "unchanged")])


def direction_counts(diff: DataFrame) -> DataFrame:
    return diff.agg(*[F.count_if(F.col("verdict_direction") == s).alias(f"verdict_{s}_count") for s in ("improved", "worsened", "unchanged")])


def status_counts(results: DataFrame, statuses: tuple[str, ...], column: str = "status") -> DataFrame:
    """(status, n) for every status of the list, 0 where none."""
    every = results.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in statuses])).alias(column))
    counted = results.groupBy(column).agg(F.count("*").alias("n"))
    return every.join(counted, column, "left").select(column, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def filtered_sums(results: DataFrame, statuses: tuple[str, ...], columns: list[str], by: list[str] = (), status: str = "status") -> DataFrame:
    return results.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col(status).isin(*statuses), F.col(c))), F.lit(0)).alias(c) for c in columns])


def merged_usage(attempts: DataFrame, by: list[str], columns: tuple[str, ...] = USAGE) -> DataFrame:
    """Sums over attempts; NULL where no attempt reports any."""
    return attempts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in columns])


def hit_rate(hits: Column, total: Column) -> Column:
    return F.round(F.try_divide(hits, F.when(total > 0, total)), 4)


def latest(runs: DataFrame, key: list[str], time: str, n: int = 1) -> DataFrame:
    """The n last rows of each key, ``back`` counting from 0; ties by the row's other columns."""
    rest = [F.col(c).desc() for c in runs.columns if c not in (*key, time)]
    back = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(time).desc(), *rest)) - 1
    return runs.withColumn("back", back).filter(F.col("back") < n)


def previous_delta(runs: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(*order))
    return runs.withColumn("previous", before).withColumn("delta", F.col(value) - F.col("previous"))


def unique_ids(runs: DataFrame, base: str, order: list[str], name: str = "run_id") -> DataFrame:
    """The base, then base-2, base-3, in order."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return runs.withColumn(name, F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), n.cast("string"))))


def failed_count(explicit: list[Column], results: Column) -> Column:
    """The greater of the reported and the observed failures."""
    said = explicit[0]
    for c in explicit[1:]:
        said = said + c
    seen = F.size(F.filter(results, lambda r: r["status"].contains("failed")))
    return F.greatest(said, seen)


def ops_summary(runs: DataFrame) -> DataFrame:
    """One row: per kind the number of runs, and the last run's id, counts and hit rate. runs: kind, run_id, generated_at, selected, cached, failed."""
    last = F.max_by(F.struct("run_id", "selected", "cached", "failed"), F.struct("generated_at", "run_id"))
    per = runs.groupBy("kind").agg(F.count("*").alias("n"), last.alias("last")).withColumn("rate", hit_rate(F.col("last.cached"), F.col("last.selected")))
    pick = lambda kind, c, name: F.max(F.when(F.col("kind") == kind, F.col(c))).alias(name)
    return per.agg(*[
        x for k in ("generation", "verification") for x in (
            F.coalesce(F.max(F.when(F.col("kind") == k, F.col("n"))), F.lit(0).cast("long")).alias(f"{k}_runs"), pick(k, "last.run_id", f"latest_{k}_run_id"), pick(k, "last.failed", f"latest_{k}_failed"), pick(k, "rate", f"latest_{k}_hit_rate"),
        )
    ])
