"""Problems of modules and their documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import verdict

# Issue kinds of a report, and their severities.
ISSUES = (("weak_claim", "weak_claims", "warning"), ("unsupported_claim", "unsupported_claims", "fail"), ("missing_factual_support", "missing_factual_support", "fail"), ("missing_uncertainty", "missing_uncertainty", "warning"))
ISSUE_COUNTS = ("weak_claims_count", "unsupported_claims_count", "missing_factual_support_count", "missing_uncertainty_count")


def module_problems(modules: DataFrame) -> DataFrame:
    """Modules with a problem: problem_types and severity. modules: module, verdict, enhanced_present, verified."""
    v = verdict(F.col("verdict"))
    types = F.array_compact(F.array(
        F.when(v == "warning", "verification_warning"), F.when(v == "fail", "verification_fail"), F.when(~F.coalesce("enhanced_present", F.lit(False)), "missing_enhanced"),
        F.when(~F.coalesce("verified", F.lit(False)), "missing_verification"),
    ))
    out = modules.withColumn("problem_types", types).filter(F.size("problem_types") > 0)
    return out.withColumn("severity", F.when(F.array_contains("problem_types", "verification_fail"), "fail").when(F.array_contains("problem_types", "verification_warning"), "warning").otherwise("info"))


def issue_problems(reports: DataFrame) -> DataFrame:
    """One row per claim of a report, with its place in the report. reports: module and an array of structs for each issue kind."""
    out = None
    for kind, column, severity in ISSUES:
        if column not in reports.columns:
            continue
        fields = reports.schema[column].dataType.elementType.names
        first = lambda *names, fields=fields: F.coalesce(*[F.col(f"x.{n}") for n in names if n in fields], F.lit(None).cast("string"))
        part = reports.select("module", F.posexplode(column).alias("position", "x")).select(
            "module", F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"), "position", first("section", "where", "location").alias("section"),
            first("reason", "why", "explanation", "issue").alias("reason"), first("claim_text", "claim", "text", "statement").alias("claim_text"),
            first("suggested_rewrite", "suggested_fix", "rewrite", "fix").alias("suggested_rewrite"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def problem_summary(modules: DataFrame) -> DataFrame:
    """One row: modules by problem, sums of issues, and no_data, partial or ok."""
    v = verdict(F.col("verdict"))
    row = modules.agg(
        F.count_if(v == "warning").alias("modules_with_warnings"), F.count_if(v == "fail").alias("modules_with_failures"),
        F.count_if(~F.coalesce("enhanced_present", F.lit(False))).alias("modules_missing_enhanced"), F.count_if(~F.coalesce("verified", F.lit(False))).alias("modules_missing_verification"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c.replace("_count", "_total")) for c in ISSUE_COUNTS if c in modules.columns], F.count("*").alias("_n"), F.count_if("verified").alias("_v"),
    )
    return row.withColumn("status", F.when(F.col("_v") == 0, "no_data").when(F.col("_v") < F.col("_n"), "partial").otherwise("ok")).drop("_n", "_v")


def problems_by_module(modules: DataFrame, reports: DataFrame) -> DataFrame:
    """(module, problem_types, severity, a count for each issue kind) of modules with a problem or an issue.

    Both as above, a module's report once; reports of modules that aren't there don't
    count, and a module without a report has no issues. Severity is the worst of the
    module's own problems and its issues.
    """
    kinds = [kind for kind, column, _ in ISSUES if column in reports.columns]
    rank = F.array_position(F.array(*[F.lit(s) for s in ("info", "warning", "fail")]), F.col("severity"))
    issues = issue_problems(reports).groupBy("module").agg(*[F.count_if(F.col("issue_type") == k).alias(k) for k in kinds], F.max(rank).alias("_issue"))
    own = module_problems(modules).select("module", "problem_types", rank.alias("_own"))
    rows = modules.select("module").join(own, "module", "left").join(issues, "module", "left")
    worst = F.greatest(F.coalesce("_own", F.lit(0)), F.coalesce("_issue", F.lit(0)))
    nothing, zero = F.array().cast("array<string>"), F.lit(0).cast("long")
    rows = rows.withColumn("_worst", worst).filter("_worst > 0")
    return rows.select("module", F.coalesce("problem_types", nothing).alias("problem_types"), F.element_at(F.array(F.lit("info"), F.lit("warning"), F.lit("fail")), F.col("_worst").cast("int")).alias("severity"), *[F.coalesce(k, zero).alias(k) for k in kinds])


def problem_order() -> list[Column]:
    return [F.array_position(F.array(F.lit("fail"), F.lit("warning"), F.lit("info")), F.col("severity")), F.col("module")]


def filter_problems(problems: DataFrame, *, module: str | None = None, severity: str | None = None, kind: str | None = None) -> DataFrame:
    out = problems if module is None else problems.filter(F.col("module") == module)
    out = out if severity is None else out.filter(F.col("severity") == severity)
    if kind is not None:
        out = out.filter(F.array_contains("problem_types", kind) if "problem_types" in problems.columns else F.col("issue_type") == kind)
    return out


def pivot_counts(problems: DataFrame, by: str, column: str, values: list[str]) -> DataFrame:
    return problems.groupBy(by).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def verdict_of_problems(n: Column) -> Column:
    return F.when(n == 0, "pass").when(n == 1, "warning").otherwise("fail")


def verdict_of_claims(severities: Column, others: Column) -> Column:
    """fail if any claim is of high severity, warning if there is any claim at all."""
    return F.when(F.exists(severities, lambda s: s == "high"), "fail").when((F.size(severities) > 0) | (others > 0), "warning").otherwise("pass")


def missing_markers(text: Column, markers: tuple[str, ...]) -> Column:
    """The markers, lower case, that a text lacks."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(~low.contains(m), F.lit(m)) for m in markers]))


def allowed_references(refs: Column, allowed: Column) -> Column:
    """References, without their documents' folder, that are allowed: each once, in order."""
    return F.array_distinct(F.filter(F.transform(refs, lambda x: F.regexp_replace(x, "^docs/generated/", "")), lambda x: F.array_contains(allowed, x)))


def consistency(fact_files: DataFrame, pages: DataFrame, limit: int = 3) -> DataFrame:
    """One row: files with facts but no page, and whether so many make the pages stale."""
    return fact_files.select("file").distinct().join(pages.select("file"), "file", "left_anti").agg(F.count("*").alias("missing")).withColumn("stale", F.col("missing") >= limit)
