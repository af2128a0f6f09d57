"""Queries over the index views, and their SQL twins. Customers stand for modules, orders for results and runs, parts for entities and files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import views
from factloom.plans.catalog import Tables, query

_STATUSES = ("generated", "skipped_cached", "failed_generation", "skipped_by_plan", "dry_run_planned")

# ---- modules

_MODULES_SQL = """modules as (select c_custkey, c_name as name, (['package', 'directory', 'feature', 'oddity'])[c_custkey % 4 + 1] as type, (['detailed', 'aggregate', 'test'])[c_nationkey % 3 + 1] as role,
    (['full', 'summary', 'skip'])[c_custkey % 3 + 1] as explain_mode, (['high', 'low'])[c_custkey % 2 + 1] as priority, 'modules/' || c_custkey || '.md' as module_doc_path,
    ['src/' || c_nationkey || '.py', 'lib/' || (c_custkey % 7) || '.ts'] as source_files, c_custkey % 5 <> 0 as factual_present, c_custkey % 3 <> 0 as enhanced_present from customer),
g as (select o_custkey as k, arg_max({'status': (['generated', 'skipped_cached', 'failed_generation', 'skipped_by_plan', 'dry_run_planned'])[o_orderkey // 2 % 5 + 1], 'context_fingerprint': case when o_orderkey % 3 = 0 then null else 'g' || o_orderkey end}, o_orderkey) as g from orders where o_orderkey % 2 = 0 and o_custkey % 6 <> 1 group by 1),
v as (select o_custkey as k, arg_max({'status': (['verified_pass', 'verified_fail', 'other'])[o_orderkey // 2 % 3 + 1], 'verifier_status': case when o_orderkey % 5 = 0 then 'parse_error' else 'ok' end, 'structured_output_valid': o_orderkey % 7 <> 0, 'verdict': (['PASS', 'warning', 'odd'])[o_orderkey // 2 % 3 + 1]}, o_orderkey) as v from orders where o_orderkey % 2 = 1 and o_custkey % 7 <> 1 group by 1),
m as (select c_custkey as k, (['Success', 'error', 'generated'])[c_custkey % 3 + 1] as generation_status, 'm' || c_custkey as context_fingerprint from customer where c_custkey % 2 = 0),
r as (select c_custkey as k, case when c_custkey % 5 = 1 then null else 'ok' end as verifier_status, case when c_custkey % 8 = 1 then null else c_custkey % 9 <> 1 end as structured_output_valid,
    (['pass', ' Warning ', 'fail', null])[c_nationkey % 4 + 1] as verdict, (c_custkey % 3)::bigint as a, (c_custkey % 4)::bigint as b, (c_custkey % 5)::bigint as c from customer where c_custkey % 4 <> 0),
index0 as (select modules.*, case when g.g.status in ('generated', 'skipped_cached') then g.g.status when not enhanced_present then 'missing' when lower(coalesce(m.generation_status, '')) in ('success', 'ok', 'generated') then 'generated' else 'unknown' end as generation_status,
    g.g.status as generation_batch_status, coalesce(g.g.context_fingerprint, m.context_fingerprint) as context_fingerprint, r.k is not null as verification_present, v.v.status as verification_batch_status,
    coalesce(r.verifier_status, v.v.verifier_status) as verifier_status, coalesce(r.structured_output_valid, v.v.structured_output_valid) as valid,
    case when lower(trim(coalesce(r.verdict, v.v.verdict))) in ('pass', 'warning', 'fail') then lower(trim(coalesce(r.verdict, v.v.verdict))) end as verdict, coalesce(r.a, 0) as unsupported_claims_count, coalesce(r.b, 0) as weak_claims_count, coalesce(r.c, 0) as missing_uncertainty_count, 0::bigint as missing_factual_support_count
    from modules left join g on c_custkey = g.k left join v on c_custkey = v.k left join m on c_custkey = m.k left join r on c_custkey = r.k),
index1 as (select *, case when not verification_present then 'missing' when verification_batch_status in ('verified_pass', 'verified_warning', 'verified_fail') then verification_batch_status
    when verifier_status = 'ok' and valid and verdict is not null then 'verified_' || verdict else 'unknown' end as verification_status from index0)"""


def _pick(values, i):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))


def _modules(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    return t.customer.select(
        F.col("c_name").alias("name"), _pick(("package", "directory", "feature", "oddity"), key % 4).alias("type"), _pick(("detailed", "aggregate", "test"), F.col("c_nationkey") % 3).alias("role"),
        _pick(("full", "summary", "skip"), key % 3).alias("explain_mode"), _pick(("high", "low"), key % 2).alias("priority"), F.concat(F.lit("modules/"), key, F.lit(".md")).alias("module_doc_path"),
        F.array(F.concat(F.lit("src/"), "c_nationkey", F.lit(".py")), F.concat(F.lit("lib/"), (key % 7).cast("string"), F.lit(".ts"))).alias("source_files"), (key % 5 != 0).alias("factual_present"), (key % 3 != 0).alias("enhanced_present"),
    )


def _index(t: Tables) -> DataFrame:
    names, k, o = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("module")), F.col("c_custkey"), F.col("o_orderkey")
    orders = t.orders.join(names, "o_custkey")
    half = F.floor(o / 2)
    made = orders.filter((o % 2 == 0) & (F.col("o_custkey") % 6 != 1)).select("module", o.alias("pos"), _pick(_STATUSES, half % 5).alias("status"), F.when(o % 3 != 0, F.concat(F.lit("g"), o.cast("string"))).alias("context_fingerprint"))
    checked = orders.filter((o % 2 == 1) & (F.col("o_custkey") % 7 != 1)).select(
        "module", o.alias("pos"), _pick(("verified_pass", "verified_fail", "other"), half % 3).alias("status"), F.when(o % 5 == 0, "parse_error").otherwise("ok").alias("verifier_status"),
        (o % 7 != 0).alias("structured_output_valid"), _pick(("PASS", "warning", "odd"), half % 3).alias("verdict"),
    )
    metadata = t.customer.filter(k % 2 == 0).select(F.col("c_name").alias("module"), _pick(("Success", "error", "generated"), k % 3).alias("generation_status"), F.concat(F.lit("m"), k.cast("string")).alias("context_fingerprint"))
    many = lambda n: F.array_repeat(F.lit("x"), n.cast("int"))
    reports = t.customer.filter(k % 4 != 0).select(
        F.col("c_name").alias("module"), F.when(k % 5 != 1, "ok").alias("verifier_status"), F.when(k % 8 != 1, k % 9 != 1).alias("structured_output_valid"), _pick(("pass", " Warning ", "fail", None), F.col("c_nationkey") % 4).alias("verdict"),
        many(k % 3).alias("unsupported_claims"), many(k % 4).alias("weak_claims"), many(k % 5).alias("missing_uncertainty"), F.lit(None).cast("array<string>").alias("missing_factual_support"),
    )
    return views.module_index(_modules(t), made, checked, metadata, reports)


@query(f"""with {_MODULES_SQL} select name, type, role, factual_present, enhanced_present, generation_status, generation_batch_status, context_fingerprint, verification_present, verification_status, verification_batch_status, verifier_status, verdict,
unsupported_claims_count, weak_claims_count, missing_uncertainty_count, missing_factual_support_count from index1""")
def module_index(t):
    return _index(t).drop("source_files", "explain_mode", "priority", "module_doc_path")


@query(f"""with {_MODULES_SQL} select count(*) as total_modules, count_if(factual_present) as with_factual, count_if(enhanced_present) as with_enhanced, count_if(verification_present) as with_verification, count_if(verdict = 'pass') as verification_pass,
count_if(verdict = 'warning') as verification_warning, count_if(verdict = 'fail') as verification_fail, count_if(not enhanced_present) as missing_enhanced, count_if(not verification_present) as missing_verification from index1""")
def module_totals(t):
    return views.module_totals(_index(t))


@query(f"""with {_MODULES_SQL} select 'doubtful' as cohort, name from index1 where verdict in ('warning', 'fail') union all select 'not_enhanced', name from index1 where not enhanced_present
union all select 'not_verified', name from index1 where enhanced_present and not verification_present""")
def module_cohorts(t):
    return views.cohorts(_index(t))


@query(f"with {_MODULES_SQL} select name, case when not enhanced_present then 'no enhanced' when verdict in ('pass', 'warning', 'fail') then 'verification ' || verdict else 'enhanced exists' end as label from index1")
def module_labels(t):
    index = _index(t)
    return index.select("name", views.module_label(index).alias("label"))


@query("""select o_orderkey, case when o_orderkey % 3 = 0 or o_orderkey % 4 = 0 or o_orderkey % 5 > 2 then 'failed_verification' else 'verified_' || (['pass', 'warning', 'fail', 'odd', null])[o_orderkey % 5 + 1] end as status from orders""")
def verification_results(t):
    o = F.col("o_orderkey")
    said = _pick(("pass", "warning", "fail", "odd", None), o % 5)
    return t.orders.select("o_orderkey", views.result_status(F.when(o % 3 == 0, "api_error").otherwise("ok"), F.when(o % 8 != 0, o % 4 != 0), said).alias("status"))


# ---- functions and search

_FUNCTIONS_SQL = f"""{_MODULES_SQL}, files as (select source_file, list_sort(list_distinct(list(name))) as module_names from (select name, unnest(source_files) as source_file from modules) group by 1),
e as (select p_partkey, (['function', 'method', 'class'])[p_partkey % 3 + 1] as entity_type, case when p_partkey % 11 = 0 then '' else 'src/' || (p_partkey % 30) || '.py' end as file, case when p_partkey % 13 = 0 then null else replace(p_name, ' ', '_') || p_partkey end as name,
    case when p_partkey % 2 = 0 then p_brand when p_partkey % 4 = 1 then '' end as container, p_size as line_start, 'def f(' || p_type || ')' as signature from part),
functions as (select name, case when coalesce(container, '') = '' then name else container || '.' || name end as qualified_name, file as source_file, case when p_partkey % 30 % 2 = 0 then 'files/' || (p_partkey % 30) || '.md' end as doc_path,
    coalesce(module_names, []) as module_names, line_start::bigint as line_start, signature from e left join files on file = source_file where entity_type in ('function', 'method') and coalesce(file, '') <> '' and coalesce(name, '') <> '')"""


def _functions(t: Tables, **of_names: Callable[[Column], Column]) -> DataFrame:
    p = F.col("p_partkey")
    entities = t.part.select(
        _pick(("function", "method", "class"), p % 3).alias("entity_type"), F.when(p % 11 == 0, "").otherwise(F.concat(F.lit("src/"), (p % 30).cast("string"), F.lit(".py"))).alias("file"),
        F.when(p % 13 != 0, F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), p.cast("string"))).alias("name"), F.when(p % 2 == 0, F.col("p_brand")).when(p % 4 == 1, "").alias("container"),
        F.col("p_size").alias("line_start"), F.concat(F.lit("def f("), "p_type", F.lit(")")).alias("signature"),
    )
    n = F.col("id").cast("string")
    pages = t.spark.range(0, 30, 2).select(F.concat(F.lit("src/"), n, F.lit(".py")).alias("source_file"), F.concat(F.lit("files/"), n, F.lit(".md")).alias("doc_path"))
    return views.function_index(entities, _modules(t), pages, of_names)


@query(f"with {_FUNCTIONS_SQL} select name, qualified_name, source_file, doc_path, sha256(array_to_string(module_names, ',')) as module_names, line_start, signature, coalesce('/file?path=' || doc_path, '/module/' || module_names[1]) as link from functions")
def function_index(t):
    rows = _functions(t, module_names=lambda names: F.sha2(F.array_join(names, ","), 256), first=views.first_name)
    return rows.withColumn("link", views.function_link(rows, F.col("first"))).drop("first")


_SEARCH = "entity_kind, entity_id, title, subtitle, module_name, path, sha256(search_text) as search_text, verification_verdict, type, problem_type, role, severity, run_kind, run_id"
_NULLS = {c: "null::varchar" for c in ("entity_kind", "entity_id", "title", "subtitle", "module_name", "path", "search_text", "verification_verdict", "type", "problem_type", "role", "severity", "run_kind", "run_id")}


def _search_sql(source: str, **columns: str) -> str:
    return "select " + ", ".join(f"{v} as {k}" for k, v in (_NULLS | columns).items()) + f" from {source}"


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("search_text", F.sha2("search_text", 256))


_MODULE_SEARCH = _search_sql(
    "index1", entity_kind="'module'", entity_id="name", title="name", subtitle="type || ' / ' || role", module_name="name", path="module_doc_path", verification_verdict="coalesce(verdict, case when not verification_present then 'missing' end)", type="type", role="role",
    search_text="array_to_string([name, type, role, explain_mode, priority, array_to_string(source_files, ' '), replace(name, '#', ' ') || ' facts', case when c_custkey % 2 = 0 then 'bold text' else '' end], ' ')",
)


@query(f"with {_MODULES_SQL}, s as ({_MODULE_SEARCH}) select {_SEARCH} from s")
def search_modules(t):
    even = F.col("module_doc_path").rlike("[02468]\\.md$")
    index = _index(t).withColumn("factual_text", F.concat(F.lit("# "), "name", F.lit("\n\n| facts |"))).withColumn("enhanced_text", F.when(even, F.lit("**bold**  `text`")))
    return _hashed(views.module_records(index))


_FILE_SEARCH = _search_sql(
    "(select page_id, regexp_replace(url, '^https?://', '') as p from pages)", entity_kind="'file'", entity_id="p", title="coalesce(list_last(list_filter(string_split(p, '/'), lambda x: x <> '' and x <> '.')), '')", subtitle="p", module_name="'m' || (page_id % 3) || ', all'", path="p",
    search_text="p || ' ' || coalesce(list_last(list_filter(string_split(p, '/'), lambda x: x <> '' and x <> '.')), '') || ' html page ' || page_id", type="'source'",
)


@query(f"with s as ({_FILE_SEARCH}) select {_SEARCH} from s where path <> ''")
def search_files(t):
    files = t.pages.select(
        F.regexp_replace("url", "^https?://", "").alias("path"), F.lit("html").alias("language"), F.lit("source").alias("file_type"), F.array(F.concat(F.lit("m"), (F.col("page_id") % 3).cast("string")), F.lit("all")).alias("module_names"),
        F.concat(F.lit("## page\n> "), F.col("page_id").cast("string")).alias("doc_text"),
    )
    return _hashed(views.file_records(files))


@query(f"with {_FUNCTIONS_SQL}, s as ({_search_sql('functions', entity_kind=chr(39) + 'function' + chr(39), entity_id='qualified_name', title='name', subtitle='source_file || chr(58) || line_start', module_name='array_to_string(module_names, chr(44) || chr(32))', path='source_file', type=chr(39) + 'function' + chr(39), search_text='qualified_name || chr(32) || source_file || chr(32) || signature')}) select {_SEARCH.replace('module_name,', 'sha256(module_name) as module_name,')} from s")
def search_functions(t):
    functions = _functions(t, module_name=lambda names: F.sha2(views.shown_names(names), 256))
    return _hashed(views.function_records(functions, F.col("module_name")))


_RUNS_SQL = """runs as (select case when o_orderkey % 2 = 0 then 'generation' else 'verification' end as kind, 'run-' || o_orderkey as run_id, strftime(o_orderdate, '%Y-%m-%d') as generated_at, case when o_orderkey % 3 > 0 then 'history/' || o_orderkey || '.json' end as manifest_path,
    ['m' || (o_orderkey % 5), 'm' || (o_orderkey % 4)] as selected_modules from orders)"""


def _runs(t: Tables) -> DataFrame:
    o = F.col("o_orderkey")
    name = lambda n: F.concat(F.lit("m"), (o % n).cast("string"))
    return t.orders.select(
        F.when(o % 2 == 0, "generation").otherwise("verification").alias("kind"), F.concat(F.lit("run-"), o.cast("string")).alias("run_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("generated_at"),
        F.when(o % 3 > 0, F.concat(F.lit("history/"), o.cast("string"), F.lit(".json"))).alias("manifest_path"), F.array(name(5), name(4)).alias("selected_modules"),
    )


@query(f"with {_RUNS_SQL}, s as ({_search_sql('runs', entity_kind='kind || chr(95) || (chr(114) || chr(117) || chr(110))', entity_id='run_id', title='run_id', subtitle='kind || (chr(32) || chr(114) || chr(117) || chr(110) || chr(32) || chr(47) || chr(32)) || generated_at', path='manifest_path', run_kind='kind', run_id='run_id', search_text='array_to_string([run_id, kind, generated_at, selected_modules[1], selected_modules[2]], chr(32))')}) select {_SEARCH} from s")
def search_runs(t):
    return _hashed(views.run_records(_runs(t)))


_PROBLEMS = _search_sql(
    "(select 'mod' || user_id as module, list_sort(list_distinct(list(event_type))) as types, min(event_id) as e from events group by user_id)", entity_kind="'problem'", entity_id="module || ':module:' || array_to_string(types, ',')", title="module || ' module problem'",
    subtitle="array_to_string(types, ', ')", module_name="module", path="'v/' || module || '.json'", verification_verdict="case when e % 2 = 0 then 'fail' end", problem_type="types[1]", severity="'high'",
    search_text="array_to_string([module, array_to_string(types, ' '), 'high', case when e % 2 = 0 then 'fail' else '' end], ' ')",
)
_ISSUES = _search_sql(
    "(select 'mod' || user_id as module, event_type, event_id, row_number() over (order by event_id) - 1 as n from events)", entity_kind="'problem'", entity_id="module || ':issue:' || event_type || ':' || n", title="module || ' ' || event_type", subtitle="'r' || (event_id % 5)", module_name="module",
    path="'v/' || module || '.json'", problem_type="event_type", severity="'low'", search_text="module || ' ' || event_type || ' low ' || ' claim r' || (event_id % 5)",
)


@query(f"with s as ({_PROBLEMS} union all {_ISSUES}) select {_SEARCH} from s")
def search_problems(t):
    name, path = F.concat(F.lit("mod"), F.col("user_id").cast("string")), F.concat(F.lit("v/mod"), F.col("user_id").cast("string"), F.lit(".json"))
    per = t.events.groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("problem_types"), F.min("event_id").alias("e"))
    problems = per.select(name.alias("module"), "problem_types", F.lit("high").alias("severity"), F.when(F.col("e") % 2 == 0, "fail").alias("verdict"), path.alias("path"))
    issues = t.events.select(
        "event_id", name.alias("module"), F.col("event_type").alias("issue_type"), F.lit("low").alias("severity"), F.lit(None).cast("string").alias("section"), F.lit("claim").alias("claim_text"),
        F.concat(F.lit("r"), (F.col("event_id") % 5).cast("string")).alias("reason"), path.alias("path"),
    )
    return _hashed(views.module_problem_records(problems).unionByName(views.issue_problem_records(issues, ["event_id"])))


# ---- runs and results


@query("""with i as (select o_orderkey as k, 'run-' || o_orderkey as run_id, strftime(o_orderdate, '%Y-%m-%d') as g, o_orderpriority as p, o_orderkey % 4 as n, case when o_orderkey % 5 = 0 then [] else ['a', 'b'] end as l, o_custkey % 9 as c, o_orderkey % 3 as f from orders),
h as (select *, k % 2 = 0 as m, case when k % 2 = 0 then coalesce(nullif(n, 0), nullif(len(case when k % 6 = 0 then ['x', 'y', 'z'] else l end), 0), nullif(k % 8, 0)) else coalesce(nullif(n, 0), nullif(len(l), 0)) end as selected,
    case when k % 2 = 0 and k % 7 > 0 then c + 1 else c end as cached from i)
select run_id, case when m and k % 10 = 0 then 'later' else g end as generated_at, case when m then 'manifest' else p end as provider, (case when m and k % 6 = 0 then 3 else len(l) end)::bigint as selected_modules_count, (case when m then k % 4 else f end)::bigint as failed_count, cached::bigint as skipped_cached_count,
run_id = 'run-8' as latest_live_run, round(cached / selected, 4) as cache_hit_rate from h""")
def history_detail(t):
    k = F.col("o_orderkey")
    listed = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b")))
    index = t.orders.select(
        F.concat(F.lit("run-"), k.cast("string")).alias("run_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("generated_at"), F.col("o_orderpriority").alias("provider"), (k % 4).alias("total_modules_selected"),
        listed.alias("selected_modules"), (F.col("o_custkey") % 9).cast("string").alias("skipped_cached_count"), (k % 3).alias("failed_count"),
    )
    manifests = t.orders.filter(k % 2 == 0).select(
        F.concat(F.lit("run-"), k.cast("string")).alias("run_id"), F.when(k % 10 == 0, "later").alias("generated_at"), F.lit("manifest").alias("provider"), F.lit(None).cast("long").alias("total_modules_selected"),
        F.when(k % 6 == 0, F.array(F.lit("x"), F.lit("y"), F.lit("z"))).alias("selected_modules"), F.when(k % 7 > 0, F.col("o_custkey") % 9 + 1).cast("string").alias("skipped_cached_count"), (k % 4).alias("failed_count"), (k % 8).alias("results"),
    )
    return views.history_detail(index, manifests, "run-8", ["failed_count", "skipped_cached_count"])


@query("""select 'run-' || o_orderkey as run_id, o_orderkey % 3 = 0 as dry_run, case when o_orderkey % 4 = 0 then 0 else o_custkey end as generated_count, case when o_orderkey = 4 then 'strict' when o_orderkey % 2 = 0 then 'same_context' end as verification_mode from orders""")
def normalized_runs(t):
    o = F.col("o_orderkey")
    rows = t.orders.select(
        F.concat(F.lit("run-"), o.cast("string")).alias("run_id"), F.col("o_orderdate").alias("generated_at"), F.when(o % 3 == 0, "true").when(o % 3 == 1, "false").alias("dry_run"),
        F.when(o % 8 == 0, "many").when(o % 4 != 0, F.col("o_custkey").cast("string")).alias("generated_count"), F.when(o % 2 == 0, "same_context").alias("verification_mode"),
    )
    return views.normalized_runs(rows, ["generated_count"], F.lit("run-4"), F.lit("strict")).drop("generated_at")


@query("""select o_orderkey, o_orderkey % 4 = 1 as cache_hit, case when o_orderkey % 3 = 0 then null when o_orderkey % 3 = 1 then o_totalprice else o_orderkey::double end as duration_seconds from orders""")
def normalized_results(t):
    o = F.col("o_orderkey")
    rows = t.orders.select("o_orderkey", F.when(o % 4 == 1, "true").when(o % 4 == 2, "0").alias("cache_hit"), F.when(o % 3 == 0, "soon").when(o % 3 == 1, F.col("o_totalprice").cast("string")).otherwise(o.cast("string")).alias("duration_seconds"))
    return views.normalized_results(rows)


@query(f"""with r as (select o_custkey % 10 as batch, (['generated', 'skipped_cached', 'failed_generation', 'skipped_by_plan', 'dry_run_planned'])[o_orderkey % 5 + 1] as status, case when o_orderkey % 4 > 0 then o_custkey end as n from orders)
select batch, count(*) as total, {", ".join(f"count_if(status = '{s}') as {s}_count" for s in _STATUSES)}, count_if(starts_with(status, 'failed')) as failed_count, count_if(status = 'generated') as estimated_generation_count,
coalesce(sum(n), 0)::bigint as estimated_input_tokens_total, count_if(status = 'generated') > 0 as network_call from r group by 1""")
def batch_totals(t):
    o = F.col("o_orderkey")
    rows = t.orders.select((F.col("o_custkey") % 10).alias("batch"), _pick(_STATUSES, o % 5).alias("status"), F.when(o % 4 > 0, F.col("o_custkey")).alias("estimated_input_tokens"))
    return views.batch_totals(rows, _STATUSES, ["batch"])


@query("""with a as (select c_mktsegment as name, min_by({'priority': 'p' || c_nationkey, 'role': c_name}, c_custkey) as a from customer where c_mktsegment <> 'BUILDING' group by 1)
select o_orderkey, coalesce(a.a.priority, 'low') as priority, coalesce(a.a.role, 'unknown') as role from orders left join a on name = (['BUILDING', 'MACHINERY', 'nowhere'])[o_orderkey % 3 + 1]""")
def result_attributes(t):
    results = t.orders.select("o_orderkey", _pick(("BUILDING", "MACHINERY", "nowhere"), F.col("o_orderkey") % 3).alias("module"))
    modules = t.customer.filter("c_mktsegment <> 'BUILDING'").select(F.col("c_mktsegment").alias("name"), "c_custkey", F.concat(F.lit("p"), "c_nationkey").alias("priority"), F.col("c_name").alias("role"))
    return views.with_module_attributes(results, modules, "c_custkey", {"priority": "low", "role": "unknown"}).drop("module")


# ---- orders


@query("select p_partkey, row_number() over (partition by p_brand order by p_size nulls first, p_name, p_type, p_partkey) as number from part")
def entity_order(t):
    rows = t.part.select("p_partkey", F.col("p_brand").alias("file"), F.col("p_size").alias("line_start"), F.col("p_name").alias("name"), F.col("p_type").alias("entity_type"))
    return views.ordered(rows, *views.FACT_ENTITIES, "p_partkey", by=("file",)).select("p_partkey", "number")


@query("""with e as (select event_id, 's' || user_id as s, event_type as i, event_id % 50 as l, case when event_id % 3 > 0 then 'f' || event_id % 7 end as r from events)
select event_id, row_number() over (partition by s order by l, i, event_id) as in_facts, row_number() over (partition by s order by i, r nulls first, event_id) as on_page from e""")
def edge_order(t):
    e = F.col("event_id")
    rows = t.events.select("event_id", F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("source_file"), F.col("event_type").alias("imported"), (e % 50).alias("line_start"), F.when(e % 3 > 0, F.concat(F.lit("f"), (e % 7).cast("string"))).alias("resolved_file"))
    facts = views.ordered(rows, *views.FACT_EDGES, "event_id", by=("source_file",)).withColumnRenamed("number", "in_facts")
    return views.ordered(facts, *views.PAGE_EDGES, "event_id", by=("source_file",)).select("event_id", "in_facts", F.col("number").alias("on_page"))


_TYPE_RANK = "coalesce(nullif(list_position(['entrypoint', 'package', 'directory', 'feature', 'name_cluster', 'test_target', 'fixture', 'test_asset', 'unknown'], type), 0) - 1, 99)"
_ROLE_RANK = "coalesce(nullif(list_position(['entrypoint', 'detailed', 'aggregate', 'test', 'unknown'], role), 0) - 1, 99)"


@query(f"with {_MODULES_SQL} select name, row_number() over (partition by priority order by {_TYPE_RANK}, {_ROLE_RANK}, type, name) as number from modules")
def module_order(t):
    return views.ordered(_modules(t).withColumnRenamed("source_files", "files"), *views.module_order(), by=("priority",)).select("name", "number")


@query("""select s_suppkey, row_number() over (partition by s_nationkey % 2 order by s_nationkey % 2, s_name, 'f' || s_suppkey % 5, 'm') as in_facts, row_number() over (partition by s_nationkey % 2 order by s_name, 'm', 'f' || s_suppkey % 5) as on_page from supplier""")
def dependency_order(t):
    rows = t.supplier.select("s_suppkey", (F.col("s_nationkey") % 2).alias("ecosystem"), F.col("s_name").alias("name"), F.concat(F.lit("f"), (F.col("s_suppkey") % 5).cast("string")).alias("source_file"), F.lit("m").alias("manifest_type"))
    facts = views.ordered(rows, *views.FACT_DEPENDENCIES, by=("ecosystem",)).withColumnRenamed("number", "in_facts")
    return views.ordered(facts, *views.PAGE_DEPENDENCIES, by=("ecosystem",)).select("s_suppkey", "in_facts", F.col("number").alias("on_page"))


# ---- texts


@query("""with w as (select doc_id, string_split(lower(text), ' ') as w from documents),
u as (select doc_id, x, min(i) as i from (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from w) group by 1, 2), o as (select doc_id, sha256(string_agg(x, '|' order by i)) as once from u group by 1)
select doc_id, once, array_to_string(list_filter(['the', 'of', 'nothing', 'die', 'de'], lambda x: list_contains(w, x)), ',') as allowed from w left join o using (doc_id)""")
def ordered_distinct(t):
    w = F.split(F.lower("text"), " ")
    refs = F.array(*[F.lit(x) for x in ("the", "of", "nothing", "die", "de", "the")])
    return t.documents.select("doc_id", F.sha2(F.array_join(F.array_distinct(w), "|"), 256).alias("once"), F.array_join(views.allowed_refs(refs, w), ",").alias("allowed"))


@query("""with s as (select doc_id, translate(lower(trim(text, ' ')), '\\/ ._', '-----') as t, text from documents), k as (select *, regexp_replace(regexp_replace(t, '[^\\p{L}\\p{N}-]', '', 'g'), '^-+|-+$', '', 'g') as k from s)
select doc_id, sha256(case when k = '' then 'unknown' else k end) as slug, substr(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '), 1, 160) as preview, replace(replace(text, 'the', 'THE'), 'THE ', 'a ') = text as same from k""")
def text_forms(t):
    return t.documents.select("doc_id", text.fingerprint(text.module_slug(F.col("text"))).alias("slug"), text.preview(F.col("text")).alias("preview"), (text.replaced(F.col("text"), {"the": "THE", "THE ": "a "}) == F.col("text")).alias("same"))


@query("""select p_partkey, '{"files": ["' || least(p_name, p_type) || '", "' || greatest(p_name, p_type) || '"], "name": "' || p_name || '", "related_files": [], "type": "' || p_brand || '"}' as identity from part""")
def identity_json(t):
    none = F.array().cast("array<string>")
    return t.part.select("p_partkey", text.identity_json(F.col("p_name"), F.col("p_brand"), files=F.array("p_type", "p_name"), related_files=none).alias("identity"))


@query("""with b as (select doc_id, regexp_replace(text, '[\\n\\r`~]', ' ', 'g') as b from documents)
select doc_id, b || (case doc_id % 5 when 0 then '' when 1 then chr(10) || '```py' || chr(10) || 'x' when 2 then chr(10) || '```' || chr(10) || 'x' || chr(10) || '````' when 3 then chr(10) || '~~~~' || chr(10) || '~~~' || chr(10) else chr(10) || '    ```' end) ||
(case doc_id % 5 when 1 then chr(10) || '```' when 3 then '~~~~' else '' end) as closed from b""")
def closed_fences(t):
    d = F.col("doc_id") % 5
    more = F.when(d == 0, "").when(d == 1, "\n```py\nx").when(d == 2, "\n```\nx\n````").when(d == 3, "\n~~~~\n~~~\n").otherwise("\n    ```")
    return t.documents.select("doc_id", text.closed_fence(F.concat(F.regexp_replace("text", "[\\n\\r`~]", " "), more)).alias("closed"))


@query("""select event_id, array_to_string(list_filter([case when event_id % 2 = 0 then 'Missing expected field: weak_claims.' end, case when event_id % 3 = 0 then 'Missing expected field: notes.' end, case when event_type not in ('click') then 'Missing or invalid verdict.' end], lambda x: x is not null), '|') as errors from events""")
def payload_errors(t):
    e = F.col("event_id")
    some = lambda test: F.when(test, F.array(F.lit("x")))
    said = F.when(F.col("event_type") == "click", "Pass").otherwise(F.col("event_type"))
    return t.events.select("event_id", F.array_join(text.payload_errors({"weak_claims": some(e % 2 != 0), "notes": some(e % 3 != 0)}, ("weak_claims", "notes"), said), "|").alias("errors"))


@query("""with s as (select event_id, (['12', 'x', null, '3.5', ' 7 '])[event_id % 5 + 1] as n, ([' True', '1', 'off', null, 'YES', 'no'])[event_id % 6 + 1] as b, (['HTTP 401', 'read timed out', 'schema said no', 'Rate limit reached', '429', 'odd'])[event_id % 6 + 1] as e,
    (['full', 'summary', 'skip'])[event_id % 3 + 1] as m, (['2024-01-02T03:04:05Z', '2024-01-02', 'soon', null])[event_id % 4 + 1] as d from events)
select event_id, case trim(n, ' ') when '12' then 12 when '7' then 7 else 0 end as whole, lower(trim(b, ' ')) in ('true', '1', 'yes', 'on') as flag,
  case when e = 'HTTP 401' then 'auth_error' when e = 'read timed out' then 'timeout' when e = 'schema said no' then 'schema_rejected' when e in ('429', 'Rate limit reached') then 'rate_limited' else 'api_error' end as provider_status,
  case m when 'full' then 3200 when 'summary' then 2200 else 1200 end as overhead, case d when '2024-01-02T03:04:05Z' then '20240102T030405Z' when '2024-01-02' then '20240102T000000Z' end as slug from s""")
def lenient_values(t):
    from factloom.operators import planning

    e = F.col("event_id")
    rows = t.events.select(
        "event_id", _pick(("12", "x", None, "3.5", " 7 "), e % 5).alias("n"), _pick((" True", "1", "off", None, "YES", "no"), e % 6).alias("b"), _pick(("HTTP 401", "read timed out", "schema said no", "Rate limit reached", "429", "odd"), e % 6).alias("e"),
        _pick(("full", "summary", "skip"), e % 3).alias("m"), _pick(("2024-01-02T03:04:05Z", "2024-01-02", "soon", None), e % 4).alias("d"),
    )
    return rows.select(
        "event_id", text.int_or_zero(F.col("n")).alias("whole"), text.truthy(F.col("b")).alias("flag"), text.provider_status(F.col("e")).alias("provider_status"), planning.prompt_overhead(F.col("m")).alias("overhead"),
        text.run_slug(text.utc_time(F.col("d"))).alias("slug"),
    )


@query("""select p_partkey, sha256('{"model":"' || p_brand || '","size":' || p_size || ',"text":' || case when p_partkey % 3 = 0 then 'null' else '"' || p_name || '"' end || '}') as key from part""")
def cache_keys(t):
    return t.part.select("p_partkey", text.cache_key(text=F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")), model=F.col("p_brand"), size=F.col("p_size")).alias("key"))


@query("""with k as (select p_partkey, (['package', 'test_target', 'directory', 'entrypoint', 'feature', 'other'])[p_partkey % 6 + 1] as b, p_size / 50.0 as share, p_partkey % 4 = 0 as tests from part),
c as (select *, case when share >= 0.6 then case when b = 'test_target' or tests then 'test_asset' else 'fixture' end else b end as type from k)
select p_partkey, type, case when type = 'entrypoint' then 'entrypoint' when type in ('fixture', 'test_asset', 'test_target') then 'test' when type = 'directory' then 'aggregate' when type in ('package', 'feature') then 'detailed' else 'unknown' end as role from c""")
def candidate_types(t):
    from factloom.operators import candidates

    p = F.col("p_partkey")
    kind = candidates.candidate_type(_pick(("package", "test_target", "directory", "entrypoint", "feature", "other"), p % 6), F.col("p_size") / 50.0, p % 4 == 0)
    return t.part.select("p_partkey", kind.alias("type")).withColumn("role", candidates.page_role(F.col("type")))


@query("""select p_partkey, row_number() over (partition by p_type order by case p_size % 3 when 0 then 2 when 1 then 1 else 0 end desc, p_brand, p_name, p_partkey) as number from part""")
def candidate_order(t):
    from factloom.operators import candidates

    rows = t.part.select("p_partkey", "p_type", F.col("p_brand").alias("type"), F.col("p_name").alias("name"), _pick(("high", "medium", "low"), F.col("p_size") % 3).alias("confidence"))
    return views.ordered(rows, candidates.rank(F.col("confidence")).desc(), "type", "name", "p_partkey", by=("p_type",)).select("p_partkey", "number")


@query("""select event_id, row_number() over (partition by event_type order by case event_id % 3 when 0 then 3 when 1 then 1 else 2 end, user_id, event_id) as number from events""")
def problem_order(t):
    from factloom.operators import quality

    rows = t.events.select("event_id", "event_type", _pick(("info", "fail", "warning"), F.col("event_id") % 3).alias("severity"), F.col("user_id").alias("module"))
    return views.ordered(rows, *quality.problem_order(), "event_id", by=("event_type",)).select("event_id", "number")


@query("""select user_id, count_if(event_id % 7 = 0) as unresolved, case when count_if(event_id % 7 = 0) > 0 then count_if(event_id % 7 = 0) || ' unresolved imports' end as warning,
array_to_string(list_sort(list_distinct(list_concat(list(event_type), ['a first', 'click']))), '|') as limitations, greatest(max(event_id % 5) + max(event_id % 3), count_if(event_id % 2 = 0))::bigint as failed from events group by 1""")
def summary_notes(t):
    from factloom.operators import profile, runs

    e = F.col("event_id")
    per = t.events.groupBy("user_id").agg(
        F.count_if(e % 7 == 0).alias("unresolved"), F.collect_list("event_type").alias("types"), F.max(e % 5).alias("a"), F.max(e % 3).alias("b"), F.collect_list(F.struct(F.when(e % 2 == 0, "failed_x").otherwise("ok").alias("status"))).alias("results")
    )
    noted = profile.warnings(per, "unresolved", "%d unresolved imports")
    failed = runs.failed_count([F.col("a"), F.col("b")], F.col("results")).cast("long")
    return noted.select("user_id", "unresolved", "warning", F.array_join(profile.limitations(F.col("types"), ("a first", "click")), "|").alias("limitations"), failed.alias("failed"))


@query("""select o_orderkey, array_to_string(list_filter(['a.md', 'b.md'], lambda x: x = 'a.md' and o_orderkey % 2 = 0 or x = 'b.md' and o_orderkey % 3 = 0), ',') as refs from orders""")
def reference_whitelist(t):
    from factloom.operators import quality

    o = F.col("o_orderkey")
    allowed = F.array_compact(F.array(F.when(o % 2 == 0, "a.md"), F.when(o % 3 == 0, "b.md"), F.lit("z.md")))
    refs = F.array(*[F.lit(x) for x in ("docs/generated/a.md", "b.md", "a.md", "c.md")])
    return t.orders.select("o_orderkey", F.array_join(quality.allowed_references(refs, allowed), ",").alias("refs"))


_KIND = "case when (o_orderkey // 2) % 2 = 0 then 'a' else 'b' end"


@query(f"""with r as (select {_KIND} as side, o_custkey as module, max({{'s': o_orderstatus, 'v': (['pass', 'fail', 'odd'])[o_orderkey % 3 + 1], 'w': o_orderkey % 4, 'p': o_orderkey % 10}}) as r from orders group by 1, 2)
select coalesce(a.module, b.module) as module, case when a.module is null then 'added' when b.module is null then 'removed' when a.r.s <> b.r.s or a.r.v <> b.r.v or a.r.w <> b.r.w or a.r.p <> b.r.p then 'changed' else 'unchanged' end as change_status,
coalesce(b.r.w, 0) - coalesce(a.r.w, 0) as weak_delta, coalesce(b.r.p, 0) - coalesce(a.r.p, 0) as prompt_delta,
case when a.r.v is null or b.r.v is null or a.r.v = 'odd' or b.r.v = 'odd' then 'unknown' when a.r.v = b.r.v then 'unchanged' when b.r.v = 'pass' then 'improved' else 'worsened' end as direction
from (select * from r where side = 'a') a full join (select * from r where side = 'b') b on a.module = b.module""")
def verification_diff(t):
    from factloom.operators import runs

    o = F.col("o_orderkey")
    zero = F.lit(0).cast("long")
    rows = t.orders.select(
        (F.floor(o / 2) % 2).alias("side"), F.col("o_custkey").alias("module"), F.col("o_orderstatus").alias("status"), _pick(("pass", "fail", "odd"), o % 3).alias("verdict"), (o % 4).alias("weak_claims_count"), (o % 10).alias("prompt_tokens"),
        *[zero.alias(c) for c in ("unsupported_claims_count", "missing_factual_support_count", "missing_uncertainty_count", "completion_tokens", "total_tokens")],
    )
    diff = runs.diff_verifications(rows.filter("side = 0"), rows.filter("side = 1"), fields=("status", "verdict"))
    return diff.select("module", "change_status", F.col("weak_claims_count_delta").alias("weak_delta"), F.col("prompt_tokens_delta").alias("prompt_delta"), F.col("verdict_direction").alias("direction"))


@query(f"""with {_RUNS_SQL} select kind, arg_max(run_id, {{'g': generated_at, 'r': run_id}}) as run_id, max(generated_at) as generated_at from runs group by 1""")
def current_runs(t):
    from factloom.streaming import history

    rows = _runs(t).withColumns({c: F.lit(0) for c in ("selected", "cached", "failed")})
    return history.current_runs(rows).select("kind", "run_id", "generated_at")


@query(f"""with {_MODULES_SQL}, f as (select name, 'source' as category, unnest(source_files) as file from modules union all select name, 'page', module_doc_path from modules) select category, file, count(*) as n from f group by 1, 2""")
def key_files(t):
    from factloom.operators import pages

    rows = _modules(t).select("name", F.col("source_files").alias("source"), F.array("module_doc_path").alias("page"))
    return pages.key_files(rows, ["source", "page"]).groupBy("category", "file").agg(F.count("*").alias("n"))


@query("""with f as (select distinct 'f' || (event_id % 40) as file from events), p as (select 'f' || (p_partkey % 37) as file from part) select count(*) as missing, count(*) >= 3 as stale from f anti join p using (file)""")
def page_consistency(t):
    from factloom.operators import quality

    file = lambda c, n: F.concat(F.lit("f"), (F.col(c) % n).cast("string")).alias("file")
    return quality.consistency(t.events.select(file("event_id", 40)), t.part.select(file("p_partkey", 37)))


@query("""select doc_id, trim(regexp_replace(text, '[\\s`]+', ' ', 'g'), ' ') as body from documents""")
def unfenced_texts(t):
    body = F.trim(F.regexp_replace("text", "[\\s`]+", " "))
    fenced = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```markdown\n"), body, F.lit("\n```\n"))).otherwise(body)
    return t.documents.select("doc_id", F.trim(text.unfenced(fenced)).alias("body"))


@query("""select c_custkey, c_name as name from customer where c_custkey in (3, 4, 8)""")
def only_modules(t):
    from factloom.operators import planning

    plan = t.customer.select("c_custkey", F.col("c_name").alias("name"), F.lit("high").alias("priority"), F.when(F.col("c_custkey") % 2 == 1, "skip").otherwise("full").alias("explain_mode"), F.lit("detailed").alias("role"), F.lit("p").alias("path"))
    chosen, skipped = planning.select_modules(plan, only=["Customer#000000003", "Customer#000000004", "Customer#000000008"])
    return chosen.select("c_custkey", "name").unionByName(skipped.select("c_custkey", "name"))
