"""Queries over context bundles and planner targets, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import context
from factloom.plans.catalog import Tables, query

# ---- bundles: six documents are a module, the first its page and the others its files'; languages are projects

_LIMIT, _INDEX = 3_000, context.GLOBAL_DOCS["function_index"]
_BLANKS = " || ".join(f"chr({ord(c)})" for c in context.BLANKS)
_SUMMARY = f"### function_index_summary\n{context.INDEX_SUMMARY[0]}{_INDEX}{context.INDEX_SUMMARY[1]}"


def _sql_cut(text: str, limit: int) -> str:
    head = f"substr({text}, 1, {limit})"
    line = f"case when contains({head}, chr(10)) then regexp_replace({head}, '\\n[^\\n]*\\z', '') else {head} end"
    return f"case when length({text}) <= {limit} then {text} else regexp_replace({line}, '[ \\t\\n\\x0B\\f\\r]+\\z', '') || chr(10) || chr(10) || '[truncated]' end"


def _sql_estimate(chars: str, n: str, files: str, blank: str) -> str:
    """Tokens of a prompt; every second module mentions the function index."""
    whole = f"({chars}) + case when m % 2 = 0 then 2 * ({n}) + {len(_SUMMARY)} else 2 * (({n}) - 1) - ({blank})::int end"
    listed = f"({files}) + case when m % 2 = 0 then {len(_INDEX) + 4} + 2 * ({n}) else 2 * (({n}) - 1) end + 4"
    return f"((700 + m % 100 + {whole} + {listed} + 3) // 4)"


def _sql_margin(tokens: str) -> str:
    return f"({tokens} + greatest(512, ({tokens} * 35 + 99) // 100))"


_DOCS_SQL = f"""d as (select coalesce(lang, 'und') as project, doc_id // 6 as m, case when doc_id % 6 = 0 then 'modules/m' || (doc_id // 6) else 'files/f' || doc_id end || '.md' as path, coalesce(text, '') as text,
    case when doc_id % 6 = 0 then 'module_doc' else 'file_doc:s' || doc_id || '.py' end as label, case when doc_id % 6 = 0 then 0 else 9 end as k from documents),
g as (select project, 'coverage-report.md' as path, min(text) as text, 'coverage_report' as label, 1 as k from d group by 1 union all select project, 'dependency-map.md', max(text), 'dependency_map', 2 from d group by 1
    union all select distinct project, 'module-map.md', 'map of ' || project, 'module_map', 3 from d union all select distinct project, 'files/index.md', 'index', 'file_index', 4 from d where project = 'en')"""
_ITEMS_SQL = f"""{_DOCS_SQL}, a as (select project, m, path, label, k, text from d union all select t.project, t.m, g.path, g.label, g.k, g.text from (select distinct project, m from d) t join g using (project)),
c as (select *, case when k = 9 then {_sql_cut("text", 2500)} when k = 2 then {_sql_cut("text", 6000)} else text end as content, row_number() over (partition by project, m order by k, label) as pos from a),
i as (select *, length(label) + length(path) + 7 as heading, length(path) + 4 as quoted, length(trim(text, {_BLANKS})) as inner_all, length(trim(content, {_BLANKS})) as inner_cut from c),
b as (select project, m, count(*) as n_docs, {_sql_estimate("sum(heading + inner_all)", "count(*)", "sum(quoted)", "arg_max(inner_all, pos) = 0")} as before from i group by 1, 2),
q as (select *, {_sql_margin("before")} > {_LIMIT} as required from b)"""
_STEP = ("r.chars + heading + inner_cut", "r.n + 1", "r.files + quoted", "inner_cut = 0")


@query(f"""with recursive {_ITEMS_SQL},
r as (select project, m, 0::bigint as pos, 0::bigint as chars, 0::bigint as n, 0::bigint as files, false as blank, []::bigint[] as kept from q where required
    union all select project, m, pos + 1, case when ok then c1 else chars end, case when ok then n1 else n end, case when ok then f1 else files end, case when ok then b1 else blank end, case when ok then list_append(kept, pos + 1) else kept end
    from (select r.project, m, r.pos, r.chars, r.n, r.files, r.blank, r.kept, {_STEP[0]} as c1, {_STEP[1]} as n1, {_STEP[2]} as f1, {_STEP[3]} as b1, k in (0, 1, 2) or k = 9 and {_sql_margin(_sql_estimate(*_STEP))} <= {_LIMIT} as ok
        from r join (select project as p2, m as m2, pos as pos2, k, heading, quoted, inner_cut from i) on p2 = r.project and m2 = r.m and pos2 = r.pos + 1)),
e as (select project, m, {_sql_estimate("chars", "n", "files", "blank")} as after, kept from r join q using (project, m) where pos = n_docs),
j as (select i.*, q.required, q.before, e.after, not q.required or list_contains(e.kept, i.pos) as held, q.required and content <> text as was_cut from i join q using (project, m) left join e using (project, m)),
o as (select project, m, required, before, coalesce(after, before) as after, coalesce(string_agg(path, ',' order by pos) filter (held and not was_cut), '') as retained, coalesce(string_agg(path, ',' order by path) filter (not held), '') as dropped,
    coalesce(string_agg(path || ':' || length(text) || ':' || length(content), ',' order by pos) filter (held and was_cut), '') as truncated,
    string_agg('### ' || label || ': ' || path || chr(10) || trim(case when required then content else text end, {_BLANKS}), chr(10) || chr(10) order by pos) filter (held) as body from j group by all)
select project, 'm' || m as module, required, required and (dropped <> '' or truncated <> '') as applied, before::bigint as before, {_sql_margin("before")}::bigint as before_margin, after::bigint as after, {_sql_margin("after")}::bigint as after_margin,
    retained || case when m % 2 = 0 then case when retained = '' then '' else ',' end || '{_INDEX}' else '' end as retained, dropped, truncated, sha256(trim(body || case when m % 2 = 0 then chr(10) || chr(10) || '{_SUMMARY}' else '' end, {_BLANKS})) as context_fingerprint from o""")
def context_bundles(t):
    targets, global_docs, texts, prompts = _bundle_inputs(t)
    asked = context.context_documents(targets, global_docs, context.measured(texts))
    rows = context.bundles(context.reductions(asked, prompts, _LIMIT), texts)
    cuts = F.transform("truncated", lambda x: F.concat_ws(":", x["path"], x["original_chars"].cast("string"), x["retained_chars"].cast("string")))
    return rows.select(
        "project", "module", "required", "applied", F.col("before.prompt_tokens").alias("before"), F.col("before.tokens_with_margin").alias("before_margin"), F.col("after.prompt_tokens").alias("after"),
        F.col("after.tokens_with_margin").alias("after_margin"), F.array_join("retained", ",").alias("retained"), F.array_join("dropped", ",").alias("dropped"), F.array_join(cuts, ",").alias("truncated"), "context_fingerprint",
    )


def _bundle_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    n, first = F.col("doc_id"), F.col("doc_id") % 6 == 0
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    docs = t.documents.select(
        F.coalesce("lang", F.lit("und")).alias("project"), F.expr("doc_id div 6").alias("m"), first.alias("first"), text("s", n, ".py").alias("source_file"), F.coalesce("text", F.lit("")).alias("text"),
        F.when(first, text("modules/m", F.expr("doc_id div 6"), ".md")).otherwise(text("files/f", n, ".md")).alias("path"),
    )
    shared = docs.groupBy("project").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
    doc = lambda path, body: F.struct(F.lit(path).alias("path"), body.alias("text"))
    shared = shared.select("project", F.inline(F.array(doc("coverage-report.md", F.col("lo")), doc("dependency-map.md", F.col("hi")), doc("module-map.md", text("map of ", F.col("project"))), doc("files/index.md", F.when(F.col("project") == "en", F.lit("index"))))))
    texts = docs.select("project", "path", "text").unionByName(shared.filter("text is not null"))
    ref = F.struct("source_file", F.col("path").alias("doc_path"), F.lit(True).alias("exists"))
    targets = docs.groupBy("project", "m").agg(F.coalesce(F.max(F.when(F.col("first"), F.col("path"))), F.lit("")).alias("module_doc_path"), F.array_sort(F.collect_list(F.when(~F.col("first"), ref))).alias("file_docs"))
    targets = targets.withColumns({"module": text("m", F.col("m")), "module_doc_exists": F.col("module_doc_path") != ""})
    prompts = targets.select("project", "module", (700 + F.col("m") % 100).alias("prompt_chars"), F.when(F.col("m") % 2 == 0, _INDEX).alias("function_index"))
    return targets, context.global_documents(docs, texts), texts, prompts


@query(f"""with {_DOCS_SQL}, n as (select unnest(['architecture', 'module_map', 'dependency_map', 'coverage_report', 'function_index', 'file_index']) as name, unnest(['architecture.md', 'module-map.md', 'dependency-map.md', 'coverage-report.md', 'functions/function-index.md', 'files/index.md']) as path),
x as (select p.project, n.path, g.path is not null as there from (select distinct project from d) p cross join n left join g on g.project = p.project and g.path = n.path)
select project, count_if(there)::bigint as present, string_agg('missing docs entry: ' || path, ',' order by path) filter (not there) as warnings from x group by 1""")
def project_documents(t):
    _, global_docs, texts, _ = _bundle_inputs(t)
    warnings = context.missing_documents(global_docs, texts).select("project", F.array_join("warnings", ",").alias("warnings"))
    return global_docs.groupBy("project").agg(F.count_if("exists").alias("present")).join(warnings, "project")


# ---- planner targets: segments are projects, customers modules, their orders files; one project's manifest lists no files

_PLANS_SQL = """m as (select c_custkey as k, c_mktsegment as project, c_name as module, (['package', 'fixture', ''])[c_custkey % 3 + 1] as type, (['full', 'summary', 'skip'])[c_custkey % 3 + 1] as mode, c_custkey % 50 as e, c_custkey % 20 as dep from customer),
o as (select o_orderkey as k, c_custkey, c_mktsegment as project, 'src/' || o_orderkey || '.py' as file, o_orderkey % 3 = 0 as fact, (o_orderkey % 700) * 10 as chars from orders join customer on o_custkey = c_custkey),
fp as (select project, file, 'files/' || case when project <> 'BUILDING' and k % 4 = 0 then 'new-' else '' end || k || '.md' as doc_path, k % 7 <> 0 as there, chars from o where project = 'BUILDING' or k % 5 <> 0),
x as (select o.project, o.c_custkey, o.file, o.fact, fp.doc_path, coalesce(fp.there, false) as there, fp.chars from o left join fp using (project, file) where fp.doc_path is not null or o.fact),
f as (select c_custkey as k, string_agg(file || '>' || coalesce(doc_path, '') || '>' || there, ',' order by file) as docs, list(distinct case when doc_path is null then 'analysis_render_mismatch: missing file page for ' || file else 'missing file doc: ' || doc_path end) filter (fact and not there) as warned,
    list(distinct 'file_doc_missing:' || file) filter (fact and not there) as missed, list(doc_path) filter (there) as pages, coalesce(sum(chars) filter (there), 0) as chars from x group by 1),
md as (select k, 'modules/' || k || '.md' as path, k % 4 <> 1 as there from m where k % 5 <> 0),
z as (select m.*, coalesce(md.path, '') as path, coalesce(md.there, false) as there, coalesce(docs, '') as docs, coalesce(warned, []) as warned, coalesce(missed, []) as missed, coalesce(pages, []) as pages, coalesce(f.chars, 0) + case when md.there then m.k * 7 else 0 end
    + case project when 'BUILDING' then 0 else 40000 + 1200 end + case mode when 'full' then 3200 when 'summary' then 2200 else 1200 end as chars from m left join f using (k) left join md using (k)),
y as (select *, (chars + 3) // 4 as tokens, not there and mode <> 'skip' as lost from z)"""


@query(f"""with {_PLANS_SQL} select module, path as module_doc_path, there as module_doc_exists, docs as file_docs, tokens::bigint as estimated_input_tokens,
    case mode when 'skip' then 0 when 'summary' then least(4000, 900 + e * 10 + dep * 8) else least(4000, 1400 + e * 16 + dep * 12) end::bigint as estimated_output_tokens, case when tokens > 24000 then 'over_limit' when tokens >= 19200 then 'near_limit' else 'ok' end as budget_status,
    array_to_string(list_sort(list_distinct(warned || ['old'] || case when lost and path <> '' then ['missing module doc: ' || path] when lost then ['analysis_render_mismatch: missing module page for ' || module || ' (' || case type when '' then 'unknown' else type end || ')'] else [] end
        || case when tokens > 24000 then ['{context.REDUCTION_NEEDED}'] else [] end)), ',') as warnings,
    array_to_string(list_sort(list_distinct(case when mode = 'skip' then [] else missed end || case when lost then ['module_doc_missing'] else [] end)), ',') as missing_context,
    array_to_string(list_sort(list_distinct(pages || case when there then [path] else [] end || case project when 'BUILDING' then [] else ['dependency-map.md', 'functions/function-index.md'] end)), ',') as context_paths,
    'docs/enhanced/modules/' || case path when '' then 'module-' || case type when '' then 'unknown' else type end || '-' || trim(regexp_replace(lower(module), '[^a-z0-9]+', '-', 'g'), '-') || '.md' else k || '.md' end as planned_output_path from y""")
def module_targets(t):
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    orders = t.orders.join(t.customer, F.col("o_custkey") == k).select(o, k, F.col("c_mktsegment").alias("project"), text("src/", o, ".py").alias("file"))
    files = orders.groupBy("c_custkey").agg(F.collect_list(F.when(o % 2 == 0, F.col("file"))).alias("source_files"), F.collect_list(F.when(o % 2 == 1, F.col("file"))).alias("test_files"))
    modules = t.customer.join(files, "c_custkey", "left").select(
        F.col("c_mktsegment").alias("project"), F.col("c_name").alias("module"), pick(("package", "fixture", ""), k % 3).alias("type"), pick(("full", "summary", "skip"), k % 3).alias("explain_mode"), (k % 50).alias("entity_count"), (k % 20).alias("dependency_count"),
        "source_files", "test_files", F.array(F.lit("old")).alias("warnings"),
    )
    sections, other = t.customer.filter("c_mktsegment <> 'BUILDING'").select(F.col("c_mktsegment").alias("project")).distinct(), F.col("project") != "BUILDING"
    page = text("files/", o, ".md")
    listed = orders.filter(other & (o % 5 != 0))
    entries = listed.select("project", F.lit(0).alias("place"), F.col("file").alias("key"), F.concat(F.lit("./"), page).alias("doc_path"))
    entries = entries.unionByName(listed.filter(o % 4 == 0).select("project", F.lit(1).alias("place"), F.col("file").alias("key"), text("files\\new-", o, ".md").alias("doc_path")))
    slugged = orders.select("project", F.col("file").alias("key"), page.alias("doc_path"))
    sizes = orders.filter(o % 7 != 0).select("project", F.when(other & (o % 4 == 0), text("files/new-", o, ".md")).otherwise(page).alias("path"), (o % 700 * 10).alias("chars"))
    customers = t.customer.select(F.col("c_mktsegment").alias("project"), k, F.col("c_name").alias("key"), text("modules/", k, ".md").alias("doc_path"))
    sizes = sizes.unionByName(customers.filter(k % 4 != 1).select("project", F.col("doc_path").alias("path"), (k * 7).alias("chars")))
    shared = F.inline(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(n).cast("long").alias("chars")) for p, n in (("dependency-map.md", 40_000), (_INDEX, 99_999), ("architecture.md", 5))]))
    sizes = sizes.unionByName(sections.select("project", shared))
    every = customers.select("project").distinct()
    module_paths = context.effective_paths(customers.filter(k % 5 != 0).select("project", F.lit(0).alias("place"), "key", "doc_path"), every, customers.limit(0), sizes)
    file_paths = context.effective_paths(entries, sections, slugged, sizes)
    facts = orders.filter(o % 3 == 0).select("project", "file")
    rows = context.module_targets(modules, module_paths, file_paths, facts, context.global_documents(every, sizes), sizes)
    docs = F.array_join(F.transform("file_docs", lambda d: F.concat_ws(">", d["source_file"], d["doc_path"], d["exists"].cast("string"))), ",")
    return rows.select(
        "module", "module_doc_path", "module_doc_exists", docs.alias("file_docs"), "estimated_input_tokens", "estimated_output_tokens", "budget_status", *[F.array_join(c, ",").alias(c) for c in ("warnings", "missing_context", "context_paths")], "planned_output_path"
    )
