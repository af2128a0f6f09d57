"""Context bundles: the documents that a module's prompt takes, their text, and what goes when it is too long.

Everything is decided on lengths, which are measured once per document; texts are
joined only to what is kept, and cut as decided. A module's documents have paths
of their own, and fit one row, as its plan does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.paths import strip_doc_prefix
from factloom.functions.text import MAX_INPUT_TOKENS, budget_status, fingerprint, let, safety_margin, slug, tokens_of_chars, truncated
from factloom.operators.planning import output_tokens, prompt_overhead

# The documents of a whole project, what a prompt takes of them in this order, what it can't do without, and how many characters stay of those that are cut.
GLOBAL_DOCS = {"architecture": "architecture.md", "module_map": "module-map.md", "dependency_map": "dependency-map.md", "coverage_report": "coverage-report.md", "function_index": "functions/function-index.md", "file_index": "files/index.md"}
TAKEN = ("coverage_report", "dependency_map", "module_map", "file_index")
KEPT = ("module_doc", "coverage_report", "dependency_map")
COUNTED, INDEX_CHARS = ("dependency_map", "coverage_report", "file_index"), 1_200
FILE_LABEL, FILE_CHARS, LABEL_CHARS = "file_doc:", 2_500, {"dependency_map": 6_000}
INDEX_SUMMARY = ("Function index available as navigation-only context: ", ". Use it only as a summary/link source.")
STRATEGY = "stage_3c_module_first_keep_module_coverage_dependency_then_file_docs_in_plan_order"
OVER_BUDGET = "estimated_prompt_tokens_over_budget"
NOTES = {
    "required": "pre_reduction_estimated_prompt_tokens_with_margin exceeded max_input_tokens",
    "dropped": "optional context files were dropped to stay within the input budget",
    "truncated": "some retained context files were truncated to deterministic char limits",
    "nothing": "no eligible context files could be dropped or truncated",
}
REDUCTION_NEEDED = "estimated input exceeded max_input_tokens_per_module; context reduction may be required in later stages"
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

_STRINGS = "array<string>"
_CUTS = sorted({FILE_CHARS, *LABEL_CHARS.values()})


def _none() -> Column:
    return F.array().cast(_STRINGS)


def _said(*texts: tuple[Column, Column | str]) -> Column:
    """The texts whose condition holds, in order."""
    return F.filter(F.array(*[F.when(ok, t if isinstance(t, Column) else F.lit(t)) for ok, t in texts]), lambda x: x.isNotNull())


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def escapes(path: Column) -> Column:
    """Whether a path is absolute or climbs above where it starts."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))
    step = lambda a, p: let(a["depth"] + F.when(p.isin("", "."), 0).when(p == "..", -1).otherwise(1), lambda d: F.struct(d.alias("depth"), F.least(a["least"], d).alias("least")))
    return plain.startswith("/") | plain.rlike("^[A-Za-z]:") | (F.aggregate(F.split(plain, "/"), start, step, lambda a: a["least"]) < 0)


# ---- which documents there are


def global_documents(projects: DataFrame, listing: DataFrame) -> DataFrame:
    """(project, name, path, exists) of a project's six documents. listing: project, path."""
    refs = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("path")) for n, p in GLOBAL_DOCS.items()])
    found = listing.filter(F.col("path").isin(*GLOBAL_DOCS.values())).select("project", "path").distinct().withColumn("exists", F.lit(True))
    rows = projects.select("project").distinct().select("project", F.inline(refs))
    return rows.join(found, ["project", "path"], "left").select("project", "name", "path", F.coalesce("exists", F.lit(False)).alias("exists"))


def missing_documents(global_docs: DataFrame, listing: DataFrame, folder: str = "modules/") -> DataFrame:
    """(project, warnings): which documents are not there, the modules' folder included, in order."""
    held = listing.filter(F.col("path").startswith(folder)).select("project").distinct().withColumn("_held", F.lit(True))
    gone = global_docs.groupBy("project").agg(F.collect_list(F.when(~F.col("exists"), F.col("path"))).alias("_gone")).join(held, "project", "left")
    paths = F.concat("_gone", F.when(F.col("_held").isNull(), F.array(F.lit(folder))).otherwise(_none()))
    return gone.select("project", F.array_sort(F.transform(paths, lambda p: F.concat(F.lit("missing docs entry: "), p))).alias("warnings"))


def effective_paths(entries: DataFrame, sections: DataFrame, slugged: DataFrame, listing: DataFrame) -> DataFrame:
    """(project, key, doc_path, exists, listed): where a key's page is, by the project's manifest, or by its slug where the manifest has no such section.

    entries: project, place (in the manifest), key, doc_path; sections: project, of
    manifests that have the section, empty ones included; slugged: project, key,
    doc_path. The last of a key's entries counts; entries without a key or path
    don't.
    """
    rows = entries.select("project", "place", "key", strip_doc_prefix(F.trim(F.replace("doc_path", F.lit("\\"), F.lit("/")))).alias("doc_path"))
    said = rows.filter((F.coalesce("key", F.lit("")) != "") & (F.coalesce("doc_path", F.lit("")) != "")).groupBy("project", "key").agg(F.max_by("doc_path", "place").alias("doc_path"))
    legacy = slugged.join(sections.select("project"), "project", "left_anti").select("project", "key", "doc_path")
    rows = said.withColumn("listed", F.lit(True)).unionByName(legacy.withColumn("listed", F.lit(False)))
    there = listing.select("project", F.col("path").alias("doc_path")).distinct().withColumn("exists", F.lit(True))
    return rows.join(there, ["project", "doc_path"], "left").select("project", "key", "doc_path", F.coalesce("exists", F.lit(False)).alias("exists"), "listed")


# ---- what the planner says of a module


def file_references(modules: DataFrame, file_paths: DataFrame, facts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(project, module, file_docs, file_warnings, file_missing, file_chars) of modules whose files have a page, or facts without one.

    modules: project, module, explain_mode, source_files, test_files; file_paths: as
    ``effective_paths`` gives them; facts: project, file; sizes: project, path, chars.
    """
    files = F.explode(F.array_distinct(F.concat(F.coalesce("source_files", _none()), F.coalesce("test_files", _none()))))
    rows = modules.select("project", "module", "explain_mode", files.alias("file"))
    known = facts.select("project", "file").distinct().withColumn("_fact", F.lit(True))
    pages = file_paths.join(sizes.select("project", F.col("path").alias("doc_path"), "chars"), ["project", "doc_path"], "left").select("project", F.col("key").alias("file"), "doc_path", "exists", "chars")
    rows = rows.join(pages, ["project", "file"], "left").join(known, ["project", "file"], "left").filter(F.col("doc_path").isNotNull() | F.col("_fact"))
    lost = F.col("_fact") & (F.col("doc_path").isNull() | ~F.col("exists"))
    warning = F.when(F.col("doc_path").isNull(), F.concat(F.lit("analysis_render_mismatch: missing file page for "), "file")).otherwise(F.concat(F.lit("missing file doc: "), "doc_path"))
    ref = F.struct(F.col("file").alias("source_file"), F.coalesce("doc_path", F.lit("")).alias("doc_path"), F.coalesce("exists", F.lit(False)).alias("exists"))
    return rows.groupBy("project", "module").agg(
        F.array_sort(F.collect_list(ref)).alias("file_docs"), F.array_sort(F.collect_set(F.when(lost, warning))).alias("file_warnings"),
        F.array_sort(F.collect_set(F.when(lost & (F.col("explain_mode") != "skip"), F.concat(F.lit("file_doc_missing:"), "file")))).alias("file_missing"),
        F.coalesce(F.sum(F.when(F.col("exists"), F.col("chars"))), F.lit(0)).alias("file_chars"),
    )


def _by_project(global_docs: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per project: each document's path, NULL if it isn't there, and the characters that the planner counts."""
    there = global_docs.filter("exists").join(sizes.select("project", "path", "chars"), ["project", "path"], "left")
    counted = F.when(F.col("name") == "function_index", F.least("chars", F.lit(INDEX_CHARS))).when(F.col("name").isin(*COUNTED), F.col("chars"))
    return there.groupBy("project").agg(*[F.max(F.when(F.col("name") == n, F.col("path"))).alias(f"_{n}") for n in GLOBAL_DOCS], F.sum(counted).alias("_global_chars"))


def module_targets(modules: DataFrame, module_paths: DataFrame, file_paths: DataFrame, facts: DataFrame, global_docs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Modules with their documents, what is missing, and how large their prompt gets.

    modules: project, module (its name), type, explain_mode, entity_count,
    dependency_count, source_files, test_files, warnings; the paths as
    ``effective_paths`` gives them, where keys are modules and files; facts: project,
    file; sizes: project, path, chars. Adds module_doc_path, module_doc_exists,
    file_docs, estimated_input_tokens, estimated_output_tokens, budget_status,
    missing_context, context_paths, context_reduction_reason, planned_output_path;
    warnings grow.
    """
    docs = module_paths.join(sizes.select("project", F.col("path").alias("doc_path"), F.col("chars").alias("_doc_chars")), ["project", "doc_path"], "left")
    docs = docs.select("project", F.col("key").alias("module"), F.col("doc_path").alias("module_doc_path"), F.col("exists").alias("module_doc_exists"), "_doc_chars")
    rows = modules.join(docs, ["project", "module"], "left").join(file_references(modules, file_paths, facts, sizes), ["project", "module"], "left").join(_by_project(global_docs, sizes), "project", "left")
    mode, name, kind = F.col("explain_mode"), F.coalesce(F.nullif(F.col("module"), F.lit("")), F.lit("unknown")), F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("unknown"))
    empty = F.array().cast("array<struct<source_file:string,doc_path:string,exists:boolean>>")
    rows = rows.withColumns({"module_doc_path": F.coalesce("module_doc_path", F.lit("")), "module_doc_exists": F.coalesce("module_doc_exists", F.lit(False)), "file_docs": F.coalesce("file_docs", empty)})
    zero, path = F.lit(0).cast("long"), F.col("module_doc_path")
    chars = F.when(F.col("module_doc_exists"), F.coalesce("_doc_chars", zero)).otherwise(zero) + F.coalesce("file_chars", zero) + F.coalesce("_global_chars", zero) + prompt_overhead(mode)
    estimate = tokens_of_chars(chars)
    unpaged = ~F.col("module_doc_exists") & (mode != "skip")
    no_page = F.concat(F.lit("analysis_render_mismatch: missing module page for "), name, F.lit(" ("), kind, F.lit(")"))
    own = _said((unpaged & (path != ""), F.concat(F.lit("missing module doc: "), path)), (unpaged & (path == ""), no_page), (estimate > MAX_INPUT_TOKENS, REDUCTION_NEEDED))
    pages = F.transform(F.filter("file_docs", lambda d: d["exists"] & (d["doc_path"] != "")), lambda d: d["doc_path"])
    shared = F.filter(F.array(*[F.col(f"_{n}") for n in ("dependency_map", "coverage_report", "function_index", "file_index")]), lambda x: x.isNotNull())
    ordered = lambda *parts: F.array_sort(F.array_distinct(F.concat(*parts)))
    output = F.when(path != "", F.element_at(F.split(path, "/"), -1)).otherwise(F.concat(slug(F.concat(F.lit("module-"), kind, F.lit("-"), name)), F.lit(".md")))
    return rows.withColumns({
        "estimated_input_tokens": estimate, "estimated_output_tokens": output_tokens(mode, F.col("entity_count"), F.col("dependency_count")), "budget_status": budget_status(estimate),
        "warnings": ordered(F.coalesce("warnings", _none()), F.coalesce("file_warnings", _none()), own),
        "missing_context": ordered(F.coalesce("file_missing", _none()), _said((unpaged, "module_doc_missing"))),
        "context_paths": ordered(_said((F.col("module_doc_exists"), path)), shared, pages),
        "context_reduction_reason": F.when(estimate > MAX_INPUT_TOKENS, REDUCTION_NEEDED), "planned_output_path": F.concat(F.lit("docs/enhanced/modules/"), output),
    }).drop("_doc_chars", "file_warnings", "file_missing", "file_chars", "_global_chars", *[f"_{n}" for n in GLOBAL_DOCS])


# ---- what a prompt takes


def measured(texts: DataFrame) -> DataFrame:
    """(project, path, chars, whole, cut_N): lengths, with and without outer blanks, of a text (project, path, text) and of what every limit leaves of it."""
    sizes = lambda t: F.struct(F.length(t).cast("long").alias("chars"), F.length(stripped(t)).cast("long").alias("inner"))
    text = F.coalesce("text", F.lit(""))
    return texts.select("project", "path", F.length(text).cast("long").alias("chars"), sizes(text).alias("whole"), *[sizes(truncated(text, n)).alias(f"cut_{n}") for n in _CUTS])


def context_documents(targets: DataFrame, global_docs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(project, module, pos, label, path, required, problem, whole, cut_N): the documents that modules' prompts ask for, in order.

    targets: as ``module_targets`` gives them; sizes: as ``measured`` gives them.
    ``problem`` is 'escapes' for a path that leaves the folder, 'missing' for one
    without a text, else NULL.
    """
    doc = lambda label, path, ok, needed: F.when(ok, F.struct(label.alias("label"), F.replace(path, F.lit("\\"), F.lit("/")).alias("path"), F.lit(needed).alias("required")))
    paths = global_docs.filter("exists").groupBy("project").agg(*[F.max(F.when(F.col("name") == n, F.col("path"))).alias(f"_{n}") for n in TAKEN])
    rows = targets.select("project", "module", "module_doc_path", "module_doc_exists", "file_docs").join(paths, "project", "left")
    first = [doc(F.lit("module_doc"), F.col("module_doc_path"), F.col("module_doc_exists") & (F.col("module_doc_path") != ""), True), *[doc(F.lit(n), F.col(f"_{n}"), F.col(f"_{n}").isNotNull(), n in KEPT) for n in TAKEN]]
    files = F.transform("file_docs", lambda d: doc(F.concat(F.lit(FILE_LABEL), d["source_file"]), d["doc_path"], d["exists"] & (d["doc_path"] != ""), False))
    rows = rows.select("project", "module", F.posexplode(F.filter(F.concat(F.array(*first), files), lambda x: x.isNotNull())).alias("pos", "d")).select("project", "module", "pos", "d.*")
    rows = rows.join(sizes.drop("chars"), ["project", "path"], "left")
    return rows.withColumn("problem", F.when(escapes(F.col("path")), "escapes").when(F.col("whole").isNull(), "missing"))


def _add(a: Column, x: Column, size: Column) -> Column:
    """The running lengths after one more document: its heading, its text, its path among the files."""
    return F.struct(
        (a["chars"] + x["heading"] + size["inner"]).alias("chars"), (a["n"] + 1).alias("n"), (a["files"] + x["quoted"]).alias("files"), (size["inner"] == 0).alias("blank"), F.concat(a["kept"], F.array(x["pos"])).alias("kept")
    )


def _lengths(a: Column, index: Column) -> tuple[Column, Column]:
    """Characters of the context, and of the list of its files as indented JSON. index: the function index's path, or NULL."""
    summary = F.length(_summary(index)).cast("long")
    context = F.when(index.isNotNull(), a["chars"] + 2 * a["n"] + summary).when(a["n"] == 0, 0).otherwise(a["chars"] + 2 * (a["n"] - 1) - a["blank"].cast("long"))
    n, files = a["n"] + index.isNotNull().cast("long"), a["files"] + F.when(index.isNotNull(), _quoted(index)).otherwise(0)
    return context, F.when(n == 0, 2).otherwise(files + 2 * (n - 1) + 4)


def _summary(index: Column) -> Column:
    return F.concat(F.lit("### function_index_summary\n" + INDEX_SUMMARY[0]), index, F.lit(INDEX_SUMMARY[1]))


def _quoted(path: Column) -> Column:
    """Characters of a path as a JSON string behind two blanks."""
    return F.length(F.to_json(F.array(path))).cast("long")


def _estimates(a: Column, index: Column, prompt_chars: Column) -> Column:
    context, files = _lengths(a, index)
    made = lambda c, p: F.struct(tokens_of_chars(c).alias("context_tokens"), p.alias("prompt_tokens"), (p + safety_margin(p)).alias("tokens_with_margin"))
    return let(tokens_of_chars(prompt_chars + context + files), lambda p: made(context, p))


def reductions(documents: DataFrame, prompts: DataFrame, limit: int = MAX_INPUT_TOKENS) -> DataFrame:
    """What each module's prompt keeps of its documents, so that it stays within ``limit`` tokens (0: any number), decided on lengths alone.

    documents: as ``context_documents`` gives them; prompts: project, module,
    prompt_chars (characters of the prompt without context and list of files),
    function_index (the path that is only mentioned, or NULL). Modules with a
    document that has a problem aren't there. A prompt that is too long keeps the
    module's page and the two first project documents, of which the second is cut;
    the other project documents go, and files' pages, cut, stay as long as they fit,
    in order; what doesn't fit is passed over.

    Returns project, module, function_index, before and after (estimates), required,
    applied, reason, taken (array of pos, label, path, limit), retained, dropped,
    truncated, notes.
    """
    is_file, label = F.col("label").startswith(FILE_LABEL), F.col("label")
    cut_to = F.when(is_file, FILE_CHARS)
    for name, n in LABEL_CHARS.items():
        cut_to = cut_to.when(label == name, n)
    cut = F.col("whole")
    for n in _CUTS:
        cut = F.when(cut_to == n, F.col(f"cut_{n}")).otherwise(cut)
    item = F.struct(
        F.col("pos"), label, F.col("path"), F.when(F.col("whole.chars") > cut_to, cut_to).alias("limit"), (F.length(label) + F.length("path") + 7).cast("long").alias("heading"), _quoted(F.col("path")).alias("quoted"),
        F.col("whole"), cut.alias("cut"), label.isin(*KEPT).alias("stays"), is_file.alias("file"),
    )
    items = documents.groupBy("project", "module").agg(F.array_sort(F.collect_list(item)).alias("_items"), F.count("problem").alias("_bad"))
    rows = prompts.select("project", "module", F.col("prompt_chars").cast("long").alias("_p"), "function_index").join(items, ["project", "module"], "left").filter(F.coalesce("_bad", F.lit(0)) == 0)
    rows = rows.withColumn("_items", F.coalesce("_items", F.array().cast(items.schema["_items"].dataType)))
    index, budget = F.col("function_index"), F.lit(limit)
    start = F.expr("struct(0L as chars, 0L as n, 0L as files, false as blank, cast(array() as array<int>) as kept)")
    rows = rows.withColumn("_all", F.aggregate("_items", start, lambda a, x: _add(a, x, x["whole"])))
    rows = rows.withColumn("before", _estimates(F.col("_all"), index, F.col("_p"))).withColumn("required", (budget > 0) & (F.col("before.tokens_with_margin") > budget))
    fits = lambda a: _estimates(a, index, F.col("_p"))["tokens_with_margin"] <= budget
    step = lambda a, x: F.when(x["stays"], _add(a, x, x["cut"])).when(x["file"], let(_add(a, x, x["cut"]), lambda more: F.when(fits(more), more).otherwise(a))).otherwise(a)
    rows = rows.withColumn("_now", F.when(F.col("required"), F.aggregate("_items", start, step)).otherwise(F.col("_all"))).withColumn("after", _estimates(F.col("_now"), index, F.col("_p")))
    held = F.filter("_items", lambda x: F.array_contains(F.col("_now.kept"), x["pos"]))
    gone = F.filter("_items", lambda x: ~F.array_contains(F.col("_now.kept"), x["pos"]))
    rows = rows.withColumns({"_held": held, "dropped": F.array_sort(F.transform(gone, lambda x: x["path"]))})
    entry = lambda x: F.struct(
        x["path"].alias("path"), F.lit("char_limit").alias("truncation_mode"), x["whole"]["chars"].alias("original_chars"), x["cut"]["chars"].alias("retained_chars"),
        tokens_of_chars(x["whole"]["chars"]).alias("original_estimated_tokens"), tokens_of_chars(x["cut"]["chars"]).alias("retained_estimated_tokens"),
    )
    was_cut = F.transform(F.filter("_held", lambda x: F.col("required") & x["limit"].isNotNull()), entry)
    rows = rows.withColumn("truncated", was_cut)
    any_dropped, any_cut = F.size("dropped") > 0, F.size("truncated") > 0
    whole = F.transform(F.filter("_held", lambda x: ~F.col("required") | x["limit"].isNull()), lambda x: x["path"])
    return rows.select(
        "project", "module", "function_index", "before", "after", "required", (F.col("required") & (any_dropped | any_cut)).alias("applied"), F.when(F.col("required"), OVER_BUDGET).alias("reason"),
        F.transform("_held", lambda x: F.struct(x["pos"].alias("pos"), x["label"].alias("label"), x["path"].alias("path"), F.when(F.col("required"), x["limit"]).alias("limit"))).alias("taken"),
        F.concat(whole, _said((index.isNotNull(), index))).alias("retained"), "dropped", "truncated",
        _said((F.col("required"), NOTES["required"]), (any_dropped, NOTES["dropped"]), (any_cut, NOTES["truncated"]), (F.col("required") & ~any_dropped & ~any_cut, NOTES["nothing"])).alias("notes"),
    )


def refused(documents: DataFrame) -> DataFrame:
    """(project, module, problems): modules whose prompt can't be made, and why, in order of the documents."""
    said = F.struct("pos", F.concat("problem", F.lit(": "), "path").alias("said"))
    return documents.filter("problem is not null").groupBy("project", "module").agg(F.array_sort(F.collect_list(said)).alias("p")).select("project", "module", F.col("p.said").alias("problems"))


def bundles(decided: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``reductions`` with context_files, context_text and context_fingerprint. texts: project, path, text."""
    asked = decided.select("project", "module", F.inline("taken"))
    content = F.coalesce("text", F.lit(""))
    for n in _CUTS:
        content = F.when(F.col("limit") == n, truncated(F.coalesce("text", F.lit("")), n)).otherwise(content)
    entry = F.concat(F.lit("### "), "label", F.lit(": "), "path", F.lit("\n"), stripped(content))
    made = asked.join(texts.select("project", "path", "text"), ["project", "path"]).groupBy("project", "module").agg(F.array_sort(F.collect_list(F.struct("pos", entry.alias("entry"), "path"))).alias("_parts"))
    rows = decided.join(made, ["project", "module"], "left")
    index = F.col("function_index")
    last = lambda c: F.concat(F.coalesce(c, _none()), _said((index.isNotNull(), _summary(index))))
    rows = rows.withColumn("context_text", stripped(F.array_join(last(F.col("_parts.entry")), "\n\n")))
    files = F.concat(F.coalesce("_parts.path", _none()), _said((index.isNotNull(), index)))
    return rows.withColumn("context_files", files).withColumn("context_fingerprint", fingerprint(F.col("context_text"))).drop("_parts")


def reduction_metadata(bundle: Callable[[str], Column] = F.col) -> Column:
    """What is recorded of a reduction, of a row of ``bundles``."""
    names = {"retained": "retained_context_files", "dropped": "dropped_context_files", "truncated": "truncated_context_files", "notes": "notes", "context_fingerprint": "context_fingerprint"}
    return F.struct(F.lit(STRATEGY).alias("strategy"), *[bundle(c).alias(n) for c, n in names.items()])
