"""Index views over plans, run results, reports and facts: what pages of a project's state are made of."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import paths
from factloom.functions.text import int_or_zero, verdict
from factloom.operators import search
from factloom.operators.numbering import numbered
from factloom.operators.runs import hit_rate

# Statuses, and the ranks of types and roles on a page.
GENERATED, VERIFIED, METADATA_OK = ("generated", "skipped_cached"), ("verified_pass", "verified_warning", "verified_fail"), ("success", "ok", "generated")
TYPE_ORDER = ("entrypoint", "package", "directory", "feature", "name_cluster", "test_target", "fixture", "test_asset", "unknown")
ROLE_ORDER = ("entrypoint", "detailed", "aggregate", "test", "unknown")
ISSUES = ("unsupported_claims", "weak_claims", "missing_uncertainty", "missing_factual_support")
VERDICTS = ("pass", "warning", "fail")


def last_of(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """(key, name): the last row of each key, by ``order``, as a struct."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias(name))


def either(first: str, second: str, field: str) -> Column:
    """A field of the first struct, or of the second where that is NULL or absent."""
    return F.coalesce(F.col(f"{first}.{field}"), F.col(f"{second}.{field}"))


def issue_count(items: Column) -> Column:
    """Entries of a list; 0 for none."""
    return F.coalesce(F.when(items.isNotNull(), F.size(items)), F.lit(0)).cast("long")


def generation_status(present: Column, status: Column, metadata_status: Column) -> Column:
    """What the last run says if it made or kept the page, else what metadata says of a page that is there."""
    from_metadata = F.when(F.lower(F.coalesce(metadata_status, F.lit(""))).isin(*METADATA_OK), "generated").otherwise("unknown")
    return F.when(status.isin(*GENERATED), status).when(~present, "missing").otherwise(from_metadata)


def verification_status(present: Column, status: Column, verifier: Column, valid: Column, said: Column) -> Column:
    told = F.when((verifier == "ok") & valid & said.isNotNull(), F.concat(F.lit("verified_"), said))
    return F.when(~present, "missing").when(status.isin(*VERIFIED), status).otherwise(F.coalesce(told, F.lit("unknown")))


def result_status(verifier: Column, valid: Column, said: Column) -> Column:
    """The status of one verification: any flaw of the answer is a failure."""
    sound = (verifier == "ok") & F.coalesce(valid, F.lit(False)) & said.isin(*VERDICTS)
    return F.when(F.coalesce(sound, F.lit(False)), F.concat(F.lit("verified_"), said)).otherwise("failed_verification")


def module_index(modules: DataFrame, generated: DataFrame, verified: DataFrame, metadata: DataFrame, reports: DataFrame) -> DataFrame:
    """One row per planned module with its page's, generation's and verification's state.

    modules: name, factual_present, enhanced_present and any other columns;
    generated and verified: module, pos (the last one counts) and result columns;
    metadata: module, generation_status, context_fingerprint; reports: module and
    report columns with the lists of ISSUES, one row of each module.
    """
    rows = modules
    for other, order, name in ((generated, "pos", "g"), (verified, "pos", "v")):
        rows = rows.join(last_of(other.withColumnRenamed("module", "name"), "name", order, name), "name", "left")
    for other, name in ((metadata, "m"), (reports, "r")):
        rows = rows.join(other.select(F.col("module").alias("name"), F.struct(*[c for c in other.columns if c != "module"]).alias(name)), "name", "left")
    present = F.col("r").isNotNull()
    said = verdict(either("r", "v", "verdict"))
    status = verification_status(present, F.col("v.status"), either("r", "v", "verifier_status"), either("r", "v", "structured_output_valid"), said)
    return rows.select(
        *modules.columns, generation_status(F.col("enhanced_present"), F.col("g.status"), F.col("m.generation_status")).alias("generation_status"), F.col("g.status").alias("generation_batch_status"),
        either("g", "m", "context_fingerprint").alias("context_fingerprint"), present.alias("verification_present"), status.alias("verification_status"), F.col("v.status").alias("verification_batch_status"),
        either("r", "v", "verifier_status").alias("verifier_status"), said.alias("verdict"), *[issue_count(F.col(f"r.{c}")).alias(f"{c}_count") for c in ISSUES],
    )


def module_totals(index: DataFrame) -> DataFrame:
    """One row of counts."""
    has, seen = F.col("enhanced_present"), F.col("verification_present")
    tests = {
        "with_factual": F.col("factual_present"), "with_enhanced": has, "with_verification": seen, **{f"verification_{v}": F.col("verdict") == v for v in VERDICTS},
        "missing_enhanced": ~has, "missing_verification": ~seen,
    }
    return index.agg(F.count("*").alias("total_modules"), *[F.count_if(F.coalesce(t, F.lit(False))).alias(c) for c, t in tests.items()])


def cohorts(index: DataFrame) -> DataFrame:
    """(cohort, name): modules with a doubtful verdict, without a page, and with a page that nothing verified."""
    tests = (("doubtful", F.col("verdict").isin("warning", "fail")), ("not_enhanced", ~F.col("enhanced_present")), ("not_verified", F.col("enhanced_present") & ~F.col("verification_present")))
    return index.select("name", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(c)) for c, t in tests]))).alias("cohort")).select("cohort", "name")


def module_label(index: DataFrame) -> Column:
    said = F.col("verdict").isin(*VERDICTS)
    return F.when(~F.col("enhanced_present"), "no enhanced").when(said, F.concat(F.lit("verification "), F.col("verdict"))).otherwise("enhanced exists")


def related_modules(modules: DataFrame) -> DataFrame:
    """(source_file, module_names): the modules of each file, in order, each once. modules: name, source_files."""
    return modules.select("name", F.explode("source_files").alias("source_file")).groupBy("source_file").agg(F.sort_array(F.collect_set("name")).alias("module_names"))


def modules_of_page(modules: DataFrame, page: str) -> DataFrame:
    """The modules that list a page among their files' pages. modules: name, file_doc_paths (structs with doc_path)."""
    return modules.filter(F.exists("file_doc_paths", lambda x: x["doc_path"] == page))


def function_index(entities: DataFrame, modules: DataFrame, pages: DataFrame, of_names: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Functions and methods with a file and a name, their qualified name, page and modules. pages: source_file, doc_path.

    of_names: columns made of a file's module names, instead of module_names. They
    are worked out once per file, so that functions don't carry long lists.
    """
    of_names = of_names or {"module_names": lambda names: names}
    some = entities.filter(F.col("entity_type").isin("function", "method") & (F.coalesce("file", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != ""))
    per_file = related_modules(modules).select("source_file", F.lit(True).alias("_some"), *[of(F.col("module_names")).alias(c) for c, of in of_names.items()])
    rows = some.withColumnRenamed("file", "source_file").join(pages, "source_file", "left").join(per_file, "source_file", "left")
    qualified = F.concat_ws(".", F.nullif(F.col("container"), F.lit("")), F.col("name"))
    nothing = F.array().cast("array<string>")
    made = [F.when(F.col("_some"), F.col(c)).otherwise(of(nothing)).alias(c) for c, of in of_names.items()]
    return rows.select("name", qualified.alias("qualified_name"), "source_file", "doc_path", *made, int_or_zero(F.col("line_start")).alias("line_start"), "signature")


def index_text(text: Column, limit: int = 20_000) -> Column:
    """The beginning of a page, without Markdown's marks, as search sees it."""
    from factloom.functions.text import plain

    return plain(F.substring(F.coalesce(text, F.lit("")), 1, limit))


def _words(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def module_records(index: DataFrame) -> DataFrame:
    """Search rows of modules. index: name, type, role, explain_mode, priority, source_files, factual_text, enhanced_text, verdict, verification_present."""
    text = _words(F.col("name"), F.col("type"), F.col("role"), F.col("explain_mode"), F.col("priority"), F.array_join("source_files", " "), index_text(F.col("factual_text")), index_text(F.col("enhanced_text")))
    shown = F.coalesce("verdict", F.when(~F.col("verification_present"), "missing"))
    return search.records(
        index, "module", entity_id=F.col("name"), title=F.col("name"), subtitle=F.concat_ws(" / ", "type", "role"), module_name=F.col("name"), path=F.col("module_doc_path"),
        search_text=text, verification_verdict=shown, type=F.col("type"), role=F.col("role"),
    )


def file_records(files: DataFrame) -> DataFrame:
    """Search rows of files with a path. files: path, language, file_type, module_names, doc_text."""
    name = paths.name(F.col("path"))
    some = files.filter(F.coalesce("path", F.lit("")) != "")
    return search.records(
        some, "file", entity_id=F.col("path"), title=name, subtitle=F.col("path"), module_name=F.array_join("module_names", ", "), path=F.col("path"),
        search_text=_words(F.col("path"), name, F.col("language"), index_text(F.col("doc_text"))), type=F.col("file_type"),
    )


def shown_names(names: Column) -> Column:
    """Module names as search rows show them."""
    return F.array_join(names, ", ")


def function_records(functions: DataFrame, module_name: Column | None = None) -> DataFrame:
    """Search rows of a function index. module_name: what stands for the joined module_names, if the index has none."""
    module_name = shown_names(F.col("module_names")) if module_name is None else module_name
    place = F.concat_ws(":", "source_file", F.col("line_start").cast("string"))
    return search.records(
        functions, "function", entity_id=F.col("qualified_name"), title=F.col("name"), subtitle=place, module_name=module_name, path=F.col("source_file"),
        search_text=_words(F.col("qualified_name"), F.col("source_file"), F.col("signature")), type=F.lit("function"),
    )


def first_name(names: Column) -> Column:
    return F.get(names, F.lit(0))


def function_link(functions: DataFrame, first: Column | None = None) -> Column:
    """Where a function is shown: on its file's page, else on its first module's. first: that module, if the index has no module_names."""
    first = first_name(F.col("module_names")) if first is None else first
    return F.coalesce(F.concat(F.lit("/file?path="), F.nullif(F.col("doc_path"), F.lit(""))), F.concat(F.lit("/module/"), first))


def run_records(runs: DataFrame) -> DataFrame:
    """Search rows of runs. runs: kind, run_id, generated_at, manifest_path, selected_modules."""
    parts = [
        search.records(
            runs.filter(F.col("kind") == k), f"{k}_run", entity_id=F.col("run_id"), title=F.col("run_id"), subtitle=F.concat(F.lit(f"{k} run / "), F.col("generated_at").cast("string")), path=F.col("manifest_path"),
            search_text=_words(F.col("run_id"), F.lit(k), F.col("generated_at"), F.array_join("selected_modules", " ")), run_kind=F.lit(k), run_id=F.col("run_id"),
        )
        for k in ("generation", "verification")
    ]
    return reduce(DataFrame.unionByName, parts)


def module_problem_records(problems: DataFrame) -> DataFrame:
    """Search rows of modules' problems. problems: module, problem_types, severity, verdict, path."""
    types = F.col("problem_types")
    return search.records(
        problems, "problem", entity_id=F.concat(F.col("module"), F.lit(":module:"), F.array_join(types, ",")), title=F.concat(F.col("module"), F.lit(" module problem")), subtitle=F.array_join(types, ", "),
        module_name=F.col("module"), path=F.col("path"), search_text=_words(F.col("module"), F.array_join(types, " "), F.col("severity"), F.col("verdict")), verification_verdict=F.col("verdict"),
        problem_type=F.get(types, F.lit(0)), severity=F.col("severity"),
    )


def issue_problem_records(issues: DataFrame, order: list[str]) -> DataFrame:
    """Search rows of single issues, numbered over all in ``order``. issues: module, issue_type, severity, section, claim_text, reason, path."""
    rows = numbered(issues, *order, first=0)
    return search.records(
        rows, "problem", entity_id=F.concat_ws(":", F.col("module"), F.lit("issue"), F.col("issue_type"), F.col("number").cast("string")), title=F.concat_ws(" ", "module", "issue_type"), subtitle=F.coalesce("reason", F.lit("")),
        module_name=F.col("module"), path=F.col("path"), search_text=_words(*[F.col(c) for c in ("module", "issue_type", "severity", "section", "claim_text", "reason")]),
        problem_type=F.col("issue_type"), severity=F.col("severity"),
    )


def normalized_runs(runs: DataFrame, counts: list[str], current_id: Column | None = None, current_mode: Column | None = None) -> DataFrame:
    """Runs with whole numbers for counts and a flag for dry_run, the newest first; the current run's own mode goes over the history's."""
    rows = runs.withColumns({c: int_or_zero(F.col(c)) for c in counts}).withColumn("dry_run", F.coalesce(F.col("dry_run").cast("boolean"), F.lit(False)))
    if current_id is not None:
        rows = rows.withColumn("verification_mode", F.when(F.col("run_id") == current_id, current_mode).otherwise(F.col("verification_mode")))
    return rows.orderBy(F.desc("generated_at"), "run_id")


def number_or_null(value: Column) -> Column:
    """A number from text or number, NULL for anything else."""
    return value.cast("string").try_cast("double")


def normalized_results(results: DataFrame) -> DataFrame:
    """Results with a flag for cache_hit and a number or NULL for duration_seconds."""
    return results.withColumn("cache_hit", F.coalesce(F.col("cache_hit").cast("boolean"), F.lit(False))).withColumn("duration_seconds", number_or_null(F.col("duration_seconds")))


def history_detail(index: DataFrame, manifests: DataFrame, current_id: str | None, counts: list[str]) -> DataFrame:
    """One row per run of an index: what its manifest says, else the index; hit rate over the first selected count above 0.

    Both: run_id, generated_at, provider, total_modules_selected, selected_modules,
    skipped_cached_count and ``counts``; manifests: results (a number of results).
    """
    a, b = index.alias("i"), manifests.alias("m")
    rows = a.join(b, F.col("i.run_id") == F.col("m.run_id"), "left")
    told = lambda c: F.coalesce(F.col(f"m.{c}"), F.col(f"i.{c}"))
    listed = F.coalesce(F.when(F.size("m.selected_modules") > 0, F.col("m.selected_modules")), F.col("i.selected_modules"))
    above = lambda c: F.when(c > 0, c)
    selected = F.coalesce(above(int_or_zero(told("total_modules_selected"))), above(F.size(listed)), above(F.col("m.results")))
    return rows.select(
        F.col("i.run_id").alias("run_id"), told("generated_at").alias("generated_at"), told("provider").alias("provider"), F.coalesce(F.size(listed), F.lit(0)).cast("long").alias("selected_modules_count"),
        *[int_or_zero(told(c)).alias(c) for c in counts], F.coalesce(F.col("i.run_id") == F.lit(current_id), F.lit(False)).alias("latest_live_run"),
        hit_rate(int_or_zero(told("skipped_cached_count")), selected).alias("cache_hit_rate"),
    )


def batch_totals(results: DataFrame, statuses: tuple[str, ...], by: list[str], dry_run: bool = False) -> DataFrame:
    """A manifest's numbers over its results: one count per status, failures, estimates and usage."""
    n = lambda s: F.count_if(F.col("status") == s)
    failed = [s for s in statuses if s.startswith("failed")]
    return results.groupBy(*by).agg(
        F.count("*").alias("total"), *[n(s).alias(f"{s}_count") for s in statuses], F.count_if(F.col("status").isin(*failed)).alias("failed_count"),
        n("dry_run_planned" if dry_run else "generated").alias("estimated_generation_count"), F.coalesce(F.sum("estimated_input_tokens"), F.lit(0)).alias("estimated_input_tokens_total"),
        (n("generated") > 0).alias("network_call"),
    )


def with_module_attributes(results: DataFrame, modules: DataFrame, order: str, defaults: dict[str, str]) -> DataFrame:
    """Results with the attributes of the first module of their name, by ``order``; defaults where there is none."""
    first = modules.groupBy("name").agg(F.min_by(F.struct(*defaults), order).alias("a")).withColumnRenamed("name", "module")
    return results.join(first, "module", "left").select(*results.columns, *[F.coalesce(F.col(f"a.{c}"), F.lit(v)).alias(c) for c, v in defaults.items()])


def rank_of(value: Column, order: tuple[str, ...], other: int = 99) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), value), F.lit(0)) - 1, F.lit(other))


def ordered(rows: DataFrame, *keys: Column | str, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows with their number, from 1, in the order of the keys, within ``by``."""
    return numbered(rows, *keys, by=by)


#: Orders of pages and facts; NULL line numbers stand last on pages.
FACT_ENTITIES = ("file", "line_start", "name", "entity_type")
FACT_EDGES, PAGE_EDGES = ("source_file", "line_start", "imported"), ("source_file", "imported", "resolved_file")
FACT_DEPENDENCIES, PAGE_DEPENDENCIES = ("ecosystem", "name", "source_file", "manifest_type"), ("name", "manifest_type", "source_file")


def module_order() -> list[Column]:
    """Types in their order, then roles, then by name and files."""
    kind = F.coalesce("type", F.lit("unknown"))
    return [rank_of(kind, TYPE_ORDER), rank_of(F.coalesce("role", F.lit("unknown")), ROLE_ORDER), kind, F.coalesce("name", F.lit("unknown")), F.col("files")]


def allowed_refs(refs: Column, allowed: Column) -> Column:
    """The references that are allowed, each once, in their order."""
    return F.array_intersect(refs, allowed)
