"""What a batch leaves behind: paths of its files, rows of work that wasn't done, summaries of runs, and the pages that say so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import int_or_zero, let, module_slug, percent, redacted
from factloom.operators.context import escapes

# Statuses of results, and what rows and pages say.
STATUSES = {
    "generation": ("generated", "skipped_cached", "skipped_by_plan", "failed_preflight", "failed_generation", "dry_run_planned"),
    "verification": ("verified_pass", "verified_warning", "verified_fail", "skipped_cached", "skipped_missing_enhanced", "failed_preflight", "failed_verification", "dry_run_planned"),
}
FAILED = {"generation": ("failed_generation", "Unsupported batch result status: "), "verification": ("failed_verification", "Unsupported verification batch result status: ")}
EXPLICIT = {"generation": ("failed_count", "failed_generation_count", "failed_preflight_count"), "verification": ("failed_count", "failed_preflight_count", "failed_verification_count")}
SUMMED = {
    "generation": ("total_modules_selected", "generated_count", "skipped_cached_count", "skipped_by_plan_count"),
    "verification": ("total_modules_selected", "verified_count", "warning_count", "skipped_cached_count", "skipped_missing_enhanced_count", "failed_preflight_count", "failed_verification_count"),
}
COUNTS = {"generation": ("generated", "skipped_cached", "skipped_by_plan", "failed"), "verification": ("verified", "warning", "failed", "skipped_cached", "skipped_missing_enhanced")}
HIDDEN = {"reasoning_details": "[redacted-reasoning]"}
SKIPPED_BY_PLAN, NO_ENHANCED = "explain_mode=skip; use --include-skip to include this module.", "Enhanced markdown is missing: "
NO_DATA = "нет данных"
NOT_CHECKED = "Проверка не дала валидного structured result. Списки ниже могут быть пустыми из-за failure extraction, а не потому что проблем нет."
NOTHING_CHECKED = "нет данных: structured verification не состоялась, поэтому отсутствие записей не означает отсутствие проблем"
CLAIMS = {"Unsupported claims": ("unsupported_claims", "claim_text"), "Weak claims": ("weak_claims", "claim_text"), "Missing uncertainty": ("missing_uncertainty", "section"), "Missing factual support": ("missing_factual_support", "section"), "Recommended fixes": ("recommended_fixes", "instruction")}
CLAIM_FIELDS = ("section", "claim_text", "reason", "instruction")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _filled(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


# ---- paths


def plain_path(path: Column) -> Column:
    """With forward slashes, no empty or dot parts, and none at the ends."""
    return F.array_join(F.filter(F.split(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", ".")), "/")


def stem(path: Column) -> Column:
    """The last part's name without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]+$", "")


def with_suffix(path: Column, suffix: str) -> Column:
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", ""), F.lit(suffix))


def enhanced_path(root: Column, doc_path: Column, module: Column) -> Column:
    """Where a module's text goes; NULL if that would leave the root."""
    doc = _filled(plain_path(doc_path))
    name = module_slug(F.coalesce(_filled(module), F.lit("unknown")))
    return F.when(doc.isNull(), _text(root, "/modules/module-", name, ".md")).when(~escapes(doc), _text(root, "/", doc))


def metadata_path(enhanced: Column) -> Column:
    """Where the run's metadata goes: beside the folder of modules."""
    return with_suffix(F.regexp_replace(enhanced, "(^|/)modules/([^/]+)$", "$1llm-runs/$2"), ".metadata.json")


def verification_path(root: Column, doc_path: Column, module: Column) -> Column:
    name = F.translate(F.coalesce(_filled(module), F.lit("unknown")), ":/\\", "---")
    doc = _filled(plain_path(doc_path))
    return _text(root, "/", F.coalesce(stem(doc), _text("module-", name)), ".verification.json")


def recorded_paths(rows: DataFrame, listing: DataFrame, path: str, root: str, cwd: str, name: str = "resolved") -> DataFrame:
    """Adds where a recorded path is: as it is if absolute, else below the first base that has it, the project's of docs/enhanced or docs/generated before ``cwd``; the first base if none has.

    listing: path, of all files that there are. NULL and empty paths stay NULL.
    """
    said, at = _filled(plain_path(F.col(path))), F.regexp_replace(F.col(root), "/+$", "")
    project = F.when(at.rlike("(^|/)docs/(enhanced|generated)$"), F.regexp_replace(at, "/?docs/(enhanced|generated)$", ""))
    below = lambda base: F.when(F.col(base).isNotNull(), F.when(F.col(base) == "", F.col("_said")).otherwise(_text(F.col(base), "/", F.col("_said"))))
    absolute = F.coalesce(F.replace(F.col(path), F.lit("\\"), F.lit("/")).startswith("/"), F.lit(False))
    out = rows.withColumns({"_said": said, "_project": project, "_cwd": F.lit(cwd.rstrip("/"))}).withColumns({"_a": F.coalesce(below("_project"), below("_cwd")), "_b": below("_cwd"), "_absolute": absolute})
    there = listing.select("path").distinct()
    for c in ("_a", "_b"):
        out = out.join(there.select(F.col("path").alias(c), F.lit(True).alias(f"{c}_there")), c, "left")
    found = F.when(F.col("_absolute"), _text("/", F.col("_said"))).when(F.col("_a_there"), F.col("_a")).when(F.col("_b_there"), F.col("_b")).otherwise(F.col("_a"))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], F.when(F.col("_said").isNotNull(), found).alias(name))


def artifact_paths(modules: DataFrame, generated: DataFrame, metadata: DataFrame, verified: DataFrame, reports: DataFrame, listing: DataFrame, root: str, cwd: str) -> DataFrame:
    """(module, enhanced_path, metadata_path, verification_json_path, verification_summary_path) by precedence: the result, the artifact, where the artifact lies, the plan.

    modules: module, module_doc_path; generated: module, output_path, metadata_path;
    metadata: those and artifact_path; verified: module, verification_json_path,
    verification_summary_path; reports: module, verification_json_path, artifact_path.
    A module has one row in each.
    """
    named = lambda df, prefix: df.select("module", *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != "module"])
    rows = modules.select("module", plain_path(F.col("module_doc_path")).alias("_doc")).withColumn("_root", F.lit(root))
    for df, prefix in ((generated, "g"), (metadata, "m"), (verified, "v"), (reports, "r")):
        rows = rows.join(named(df, prefix), "module", "left")
    said = {"_enhanced": F.coalesce("g_output_path", "m_output_path"), "_metadata": F.coalesce("g_metadata_path", "m_metadata_path"), "_json": F.coalesce("v_verification_json_path", "r_verification_json_path"), "_summary": F.col("v_verification_summary_path")}
    rows = rows.withColumns(said)
    for c in said:
        rows = recorded_paths(rows, listing, c, "_root", cwd, f"{c}_at")
    planned = F.when(F.col("_doc") != "", _text(root + "/", F.col("_doc")))
    checked = F.when(F.col("_doc") != "", _text(root + "/verification/", stem(F.col("_doc")), ".verification.json"))
    rows = rows.withColumn("verification_json_path", F.coalesce("_json_at", "r_artifact_path", checked))
    return rows.select(
        "module", F.coalesce("_enhanced_at", planned).alias("enhanced_path"), F.coalesce("_metadata_at", "m_artifact_path").alias("metadata_path"), "verification_json_path",
        F.coalesce("_summary_at", with_suffix(F.col("verification_json_path"), ".md")).alias("verification_summary_path"),
    )


# ---- rows of results


def unworked(plan: DataFrame, written: DataFrame, root: str, *, include_skip: bool = False, required: tuple[str, ...] = ()) -> DataFrame:
    """(module, status, output_path, error): modules that a verification can't take: those the plan skips, and those without a text, an error only for ``required`` ones.

    plan: module, module_doc_path, explain_mode; written: path.
    """
    rows = plan.select("module", "explain_mode", enhanced_path(F.lit(root), F.col("module_doc_path"), F.col("module")).alias("output_path"))
    there = written.select(F.col("path").alias("output_path"), F.lit(True).alias("_there")).distinct()
    rows = rows.join(there, "output_path", "left")
    skipped = (F.col("explain_mode") == "skip") & F.lit(not include_skip)
    asked = F.col("module").isin(*required) if required else F.lit(False)
    status = F.when(skipped, "skipped_by_plan").when(F.col("output_path").isNull() | (F.col("_there").isNull() & asked), "failed_preflight").when(F.col("_there").isNull(), "skipped_missing_enhanced")
    error = F.when(skipped, SKIPPED_BY_PLAN).when(F.col("output_path").isNull(), "Enhanced output path escapes output root").when(status == "failed_preflight", _text(NO_ENHANCED, F.col("output_path")))
    return rows.select("module", status.alias("status"), "output_path", error.alias("error")).filter("status is not null")


def finished(results: DataFrame, kind: str) -> DataFrame:
    """Results with a known status (an unknown one is a failure that says so) and a duration of three places, 0 at least."""
    status, (failed, said) = F.coalesce("status", F.lit("")), FAILED[kind]
    known = status.isin(*STATUSES[kind])
    return results.withColumns({"status": F.when(known, status).otherwise(failed), "error": F.when(known, F.col("error")).otherwise(_text(said, status)), "duration_seconds": F.round(F.greatest(F.lit(0.0), F.col("duration_seconds").cast("double")), 3)})


def batch_summaries(manifests: DataFrame, results: DataFrame, kind: str, secrets: tuple[str, ...] = ()) -> DataFrame:
    """A manifest's numbers, the failures reported or seen, whichever are more, and its modules' statuses in order, without secrets.

    manifests: run_id, network_call, selected_modules and counts as they were
    recorded; results: run_id, pos, module, status, error. A batch's modules are
    bounded by its plan.
    """

    def clean(c: Column) -> Column:
        out = redacted(c, *[F.lit(s) for s in secrets], mask="[redacted]")
        for word, mask in HIDDEN.items():
            out = F.replace(out, F.lit(word), F.lit(mask))
        return out

    told = lambda c: clean(F.coalesce(F.col(c), F.lit(""))).alias(c)
    row = F.struct("pos", told("module"), told("status"), clean(_filled(F.col("error"))).alias("error"))
    seen = results.groupBy("run_id").agg(F.array_sort(F.collect_list(row)).alias("_rows"), F.count_if(F.col("status").startswith("failed" if kind == "generation" else "failed_")).alias("_seen"))
    number = lambda c: int_or_zero(F.col(c)) if c in manifests.columns else F.lit(0).cast("long")
    explicit = sum((number(c) for c in EXPLICIT[kind]), F.lit(0).cast("long"))
    statuses = F.transform("_rows", lambda x: F.struct(x["module"].alias("module"), x["status"].alias("status"), x["error"].alias("error")))
    empty = F.array().cast("array<struct<module:string,status:string,error:string>>")
    return manifests.join(seen, "run_id", "left").select(
        "run_id", F.lit(kind).alias("kind"), F.transform(F.coalesce("selected_modules", F.array().cast("array<string>")), clean).alias("selected_modules"), *[number(c).alias(c) for c in SUMMED[kind]],
        F.greatest(explicit, F.coalesce("_seen", F.lit(0).cast("long"))).alias("failed_total"), "network_call", F.coalesce(statuses, empty).alias("module_statuses"),
    )


# ---- runs


def run_headers(runs: DataFrame, kind: str, label: str = "run") -> DataFrame:
    """Runs with selected_modules_count (that of the list where the number is 0 or not one), latest_live_run and problem, which says that a run is of another kind. A run without a kind is of any."""
    count = int_or_zero(F.col("selected_modules_count"))
    listed = F.greatest(F.coalesce(F.size("selected_modules"), F.lit(0)), F.lit(0)).cast("long")
    other = F.coalesce((F.col("kind") != "") & (F.col("kind") != kind), F.lit(False))
    return runs.withColumns({
        "selected_modules_count": F.when(count != 0, count).otherwise(listed), "latest_live_run": F.coalesce(F.col("latest_live_run").cast("boolean"), F.lit(False)), "problem": F.when(other, _text(f"{label} kind mismatch: expected {kind}, got ", F.col("kind"))),
    })


def usage_json(usage: Column) -> Column:
    """A map of numbers as JSON with its keys in order, blanks behind colons and commas; null for none."""
    entry = lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(": "), F.coalesce(e["value"].cast("string"), F.lit("null")))
    return F.when(usage.isNull(), "null").otherwise(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(usage)), entry), ", "), F.lit("}")))


def ops_page(summary: DataFrame, name: str = "page") -> DataFrame:
    """Adds the page on the last runs of both kinds.

    summary: for each kind K latest_K_run_id, latest_K_counts (a struct of COUNTS, or
    NULL), latest_K_usage_totals (a map), latest_K_cache_hit_rate, K_history_count and
    K_warnings; the warnings of both stand one behind the other, without empty ones.
    """

    def section(kind: str) -> Column:
        counts = F.col(f"latest_{kind}_counts")
        said = [_text("- run_id: ", F.col(f"latest_{kind}_run_id")), *[_text(f"- {c}: ", F.coalesce(counts[c], F.lit(0)).cast("string")) for c in COUNTS[kind]], _text("- usage_totals: ", usage_json(F.col(f"latest_{kind}_usage_totals")))]
        return F.when(_filled(F.col(f"latest_{kind}_run_id")).isNotNull() & counts.isNotNull(), F.concat_ws("\n", *said)).otherwise(NO_DATA)

    rate = lambda kind: F.coalesce(percent(F.col(f"latest_{kind}_cache_hit_rate")), F.lit(NO_DATA))
    none = F.array().cast("array<string>")
    warnings = F.filter(F.concat(*[F.coalesce(f"{k}_warnings", none) for k in COUNTS]), lambda w: F.coalesce(w, F.lit("")) != "")
    listed = let(warnings, lambda w: F.when(F.size(w) > 0, F.array_join(F.transform(w, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(NO_DATA))
    held = lambda kind: F.coalesce(F.col(f"{kind}_history_count").cast("string"), F.lit("0"))
    texts = [
        F.lit("# Ops Summary\n\n## Latest generation run"), section("generation"), F.lit("\n## Latest verification run"), section("verification"), F.lit("\n## History counts"), _text("- Generation: ", held("generation")), _text("- Verification: ", held("verification")),
        F.lit("\n## Cache effectiveness"), _text("- Generation cache hit rate: ", rate("generation")), _text("- Verification cache hit rate: ", rate("verification")), F.lit("\n## Recent warnings"), listed, F.lit(""),
    ]
    return summary.withColumn(name, F.concat_ws("\n", *texts))


def verification_page(reports: DataFrame, name: str = "page") -> DataFrame:
    """Adds a report's page for people.

    reports: module, verdict, verifier_status, provider_status (JSON text),
    structured_output_valid, context_source, context_fingerprint,
    factual_context_files, parse_errors, and the arrays of CLAIMS, structs of
    CLAIM_FIELDS. A list that is empty because nothing was checked says so.
    """
    failed = F.coalesce(F.col("verifier_status") != "ok", F.lit(True))
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    flag = lambda c: F.coalesce(F.initcap(F.col(c).cast("string")), F.lit("None"))

    def items(column: str, first: str) -> Column:
        primary = lambda x: F.coalesce(*[_filled(x[c]) for c in (first, "reason", "claim_text", "section")])
        said = F.filter(F.transform(column, primary), lambda x: x.isNotNull())
        some = F.array_join(F.transform(said, lambda x: F.concat(F.lit("- "), x)), "\n")
        return F.when(F.coalesce(F.size(column), F.lit(0)) <= 0, F.when(failed, NOTHING_CHECKED).otherwise(NO_DATA)).when(some != "", some).otherwise(NO_DATA)

    bullets = lambda c: F.transform(c, lambda x: F.concat(F.lit("- "), F.coalesce(x, F.lit("None"))))
    errors = F.when(F.coalesce(F.size("parse_errors"), F.lit(0)) > 0, F.array_join(bullets("parse_errors"), "\n")).otherwise(NO_DATA)
    texts = [
        _text("# Проверка модуля: ", shown(F.col("module"))), F.lit("\n## Вердикт"), F.coalesce(_filled(F.col("verdict")), F.lit(NO_DATA)), F.lit("\n## Статус проверки"), _text("- verifier_status: ", shown(F.col("verifier_status"))),
        _text("- provider_status: ", F.coalesce("provider_status", F.lit("null"))), _text("- structured_output_valid: ", flag("structured_output_valid")), F.when(failed, NOT_CHECKED).otherwise(""),
    ]
    for heading, (column, first) in CLAIMS.items():
        texts += [F.lit(f"\n## {heading}"), items(column, first)]
    files = bullets("factual_context_files")
    texts += [F.lit("\n## Контекст проверки"), _text("- context_source: ", shown(F.col("context_source"))), _text("- context_fingerprint: ", shown(F.col("context_fingerprint")))]
    texts += [F.when(F.size("factual_context_files") > 0, F.array_join(files, "\n")), F.lit("\n## Ошибки извлечения"), errors, F.lit("")]
    return reports.withColumn(name, F.concat_ws("\n", *texts))
