"""Queries over what batches leave behind, and their SQL twins: customers stand for modules, runs and reports, orders for results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import text as texts
from factloom.operators import batch_results as results
from factloom.plans.catalog import query

_ROOT = "/p/docs/enhanced"


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


def _pick(values, i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))


def _recorded(c: str) -> str:
    return f"case when starts_with({c}, '/') then {c} when '/p/' || {c} in (select path from l) then '/p/' || {c} when '/cwd/' || {c} in (select path from l) then '/cwd/' || {c} else '/p/' || {c} end"


@query(f"""with l as (select '/p/docs/x' || p_partkey || '.md' as path from part where p_partkey % 8 = 0 union select '/cwd/other/' || p_partkey || '.md' from part where p_partkey % 2 = 1),
s as (select c_custkey as k, c_name as module, case when c_custkey % 6 > 0 then 'm' || c_custkey end as doc, case when c_custkey % 2 = 0 and c_custkey % 4 = 0 then 'docs/x' || c_custkey || '.md' when c_custkey % 5 < 3 then 'other/' || c_custkey || '.md' end as e,
    case when c_custkey % 2 = 0 and c_custkey % 3 = 0 then '/abs/' || c_custkey || '.json' end as m, case when c_custkey % 5 < 3 then '/art/' || c_custkey || '.json' end as ma, case when c_custkey % 7 < 4 and c_custkey % 2 = 1 then 'v/' || c_custkey || '.json' end as j,
    case when c_custkey % 9 < 5 then '/rep/' || c_custkey || '.json' end as ja, case when c_custkey % 7 < 4 and c_custkey % 4 = 1 then 'v/' || c_custkey || '.txt' end as t from customer),
r as (select *, coalesce({_recorded("j")}, ja, '{_ROOT}/verification/' || doc || '.verification.json') as json from s)
select module, coalesce({_recorded("e")}, '{_ROOT}/modules/' || doc || '.md') as enhanced_path, coalesce({_recorded("m")}, ma) as metadata_path, json as verification_json_path, coalesce({_recorded("t")}, regexp_replace(json, '\\.json$', '.md')) as verification_summary_path from r""")
def artifact_paths(t):
    k, p, name, none = F.col("c_custkey"), F.col("p_partkey"), F.col("c_name").alias("module"), F.lit(None).cast("string")
    modules = t.customer.select(name, F.when(k % 6 > 0, _text("modules\\m", k, ".md")).alias("module_doc_path"))
    generated = t.customer.filter(k % 2 == 0).select(name, F.when(k % 4 == 0, _text("docs/./x", k, ".md")).alias("output_path"), F.when(k % 3 == 0, _text("/abs/", k, ".json")).alias("metadata_path"))
    metadata = t.customer.filter(k % 5 < 3).select(name, _text("other/", k, ".md").alias("output_path"), none.alias("metadata_path"), _text("/art/", k, ".json").alias("artifact_path"))
    verified = t.customer.filter(k % 7 < 4).select(name, F.when(k % 2 == 1, _text("v/", k, ".json")).alias("verification_json_path"), F.when(k % 4 == 1, _text("v/", k, ".txt")).alias("verification_summary_path"))
    reports = t.customer.filter(k % 9 < 5).select(name, none.alias("verification_json_path"), _text("/rep/", k, ".json").alias("artifact_path"))
    listing = t.part.filter(p % 8 == 0).select(_text("/p/docs/x", p, ".md").alias("path")).unionByName(t.part.filter(p % 2 == 1).select(_text("/cwd/other/", p, ".md").alias("path")))
    return results.artifact_paths(modules, generated, metadata, verified, reports, listing, _ROOT, "/cwd")


@query(f"""with m as (select c_name as module, c_custkey as k, case when c_custkey % 11 = 0 then null when c_custkey % 4 = 0 then 'out/modules/module-' || replace(lower(c_name), '#', '') || '.md' else 'out/modules/' || c_custkey || '.md' end as path,
    c_custkey % 3 = 0 as skip, c_custkey % 2 = 0 and exists (select 1 from part where p_partkey = c_custkey) and c_custkey % 4 > 0 as there from customer),
s as (select *, case when skip then 'skipped_by_plan' when path is null then 'failed_preflight' when not there then 'skipped_missing_enhanced' end as status from m)
select module, status, path as output_path, case when skip then '{results.SKIPPED_BY_PLAN}' when path is null then 'Enhanced output path escapes output root' end as error from s where status is not null""")
def unworked_modules(t):
    k, p = F.col("c_custkey"), F.col("p_partkey")
    doc = F.when(k % 11 == 0, "modules/../../x.md").when(k % 4 > 0, _text("modules/", k, ".md"))
    plan = t.customer.select(F.col("c_name").alias("module"), doc.alias("module_doc_path"), F.when(k % 3 == 0, "skip").otherwise("full").alias("explain_mode"))
    return results.unworked(plan, t.part.filter(p % 2 == 0).select(_text("out/modules/", p, ".md").alias("path")), "out")


@query("""with o as (select o_custkey, o_orderkey, (['generated', 'failed_preflight', 'failed', 'skipped_cached', 'odd'])[o_orderkey % 5 + 1] as status, case when o_orderkey % 3 = 0 then 'why key-1 reasoning_details' when o_orderkey % 3 = 1 then '' end as error from orders),
f as (select *, case when status in ('failed', 'odd') then 'failed_generation' else status end as s, case when status in ('failed', 'odd') then 'Unsupported batch result status: ' || status when error = '' then null when error is not null then 'why [redacted] [redacted-reasoning]' end as e from o),
r as (select o_custkey as k, count_if(starts_with(s, 'failed')) as seen, string_agg('O' || o_orderkey || ':' || s || ':' || coalesce(e, '-'), ',' order by o_orderkey) as statuses from f group by 1)
select c_name as run_id, 'generation' as kind, 'a,[redacted]' as selected_modules, (c_custkey % 40)::bigint as total_modules_selected, 0::bigint as generated_count, (c_custkey % 4)::bigint as skipped_cached_count, 0::bigint as skipped_by_plan_count,
    greatest(coalesce(case when c_custkey % 2 = 0 then c_custkey % 9 end, 0) + c_custkey % 3, coalesce(seen, 0))::bigint as failed_total, case when c_custkey % 5 > 0 then c_custkey % 5 = 1 end as network_call, coalesce(statuses, '') as module_statuses from customer left join r on k = c_custkey""")
def result_summaries(t):
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    manifests = t.customer.select(
        F.col("c_name").alias("run_id"), F.array(F.lit("a"), F.lit("key-1")).alias("selected_modules"), (k % 40).cast("string").alias("total_modules_selected"), (k % 4).alias("skipped_cached_count"), F.when(k % 2 == 0, (k % 9).cast("string")).otherwise("none").alias("failed_count"),
        (k % 3).alias("failed_preflight_count"), F.when(k % 5 > 0, k % 5 == 1).alias("network_call"),
    )
    rows = t.orders.join(t.customer, F.col("o_custkey") == k).select(
        F.col("c_name").alias("run_id"), o.alias("pos"), _text("O", o).alias("module"), _pick(("generated", "failed_preflight", "failed", "skipped_cached", "odd"), o % 5).alias("status"), F.when(o % 3 == 0, "why key-1 reasoning_details").when(o % 3 == 1, "").alias("error"), F.lit(0.5).alias("duration_seconds"),
    )
    out = results.batch_summaries(manifests, results.finished(rows, "generation"), "generation", ("key-1",))
    said = F.transform("module_statuses", lambda x: F.concat_ws(":", x["module"], x["status"], F.coalesce(x["error"], F.lit("-"))))
    return out.withColumns({"selected_modules": F.array_join("selected_modules", ","), "module_statuses": F.array_join(said, ",")})


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then o_orderkey % 5 + 2 else o_orderkey % 4 end::bigint as selected_modules_count, o_orderkey % 7 = 0 as latest_live_run,
    case when o_orderkey % 5 = 0 then 'run kind mismatch: expected generation, got verification' end as problem from orders""")
def run_headers(t):
    o = F.col("o_orderkey")
    listed = F.array_repeat(F.lit("m"), F.when(o % 3 == 0, o % 5 + 2).otherwise(o % 4).cast("int"))
    said = F.when(o % 3 == 0, "0").when(o % 2 == 0, (o % 4).cast("string"))
    rows = t.orders.select(o, _pick(("verification", "generation", "", None, "generation"), o % 5).alias("kind"), said.alias("selected_modules_count"), listed.alias("selected_modules"), F.when(o % 7 == 0, "true").alias("latest_live_run"))
    return results.run_headers(rows, "generation").drop("kind", "selected_modules")


@query(f"""with s as (select *, c_custkey as k, c_custkey % 4 > 0 as g, c_custkey % 3 > 0 as v from customer)
select c_name, sha256(E'# Ops Summary\n\n## Latest generation run\n' || case when g then '- run_id: g' || k || E'\n- generated: ' || k % 10 || E'\n- skipped_cached: ' || k % 4 || E'\n- skipped_by_plan: 0\n- failed: 1\n- usage_totals: ' || case when k % 5 = 0 then 'null' else '{{"completion": null, "prompt": ' || k || '}}' end else '{results.NO_DATA}' end
    || E'\n\n## Latest verification run\n' || case when v then '- run_id: v' || k || E'\n- verified: 3\n- warning: 0\n- failed: ' || k % 7 || E'\n- skipped_cached: 0\n- skipped_missing_enhanced: 2\n- usage_totals: null' else '{results.NO_DATA}' end
    || E'\n\n## History counts\n- Generation: ' || k % 20 || E'\n- Verification: 0\n\n## Cache effectiveness\n- Generation cache hit rate: ' || case when k % 8 = 0 then '{results.NO_DATA}' else printf('%.1f%%', (k % 8) / 8.0 * 100) end || E'\n- Verification cache hit rate: 50.0%\n\n## Recent warnings\n'
    || case when k % 2 = 0 and k % 6 > 0 then '- w' || k || E'\n- ' || c_mktsegment when k % 2 = 0 then '- w' || k when k % 6 > 0 then '- ' || c_mktsegment else '{results.NO_DATA}' end || E'\n') as page from s""")
def ops_pages(t):
    k, none = F.col("c_custkey"), F.lit(None).cast("int")
    counts = lambda kind, *values: F.struct(*[v.cast("int").alias(c) for c, v in zip(results.COUNTS[kind], values, strict=True)])
    n = lambda x: F.lit(x)
    rows = t.customer.select(
        "c_name", F.when(k % 4 > 0, _text("g", k)).alias("latest_generation_run_id"), counts("generation", k % 10, k % 4, none, n(1)).alias("latest_generation_counts"), F.when(k % 5 > 0, F.create_map(F.lit("prompt"), k, F.lit("completion"), F.lit(None).cast("long"))).alias("latest_generation_usage_totals"),
        F.when(k % 8 > 0, (k % 8) / 8.0).alias("latest_generation_cache_hit_rate"), (k % 20).alias("generation_history_count"), F.array(F.when(k % 2 == 0, _text("w", k)).otherwise("")).alias("generation_warnings"),
        _text("v", k).alias("latest_verification_run_id"), F.when(k % 3 > 0, counts("verification", n(3), n(0), k % 7, none, n(2))).alias("latest_verification_counts"), F.lit(None).cast("map<string,bigint>").alias("latest_verification_usage_totals"),
        F.lit(0.5).alias("latest_verification_cache_hit_rate"), none.alias("verification_history_count"), F.when(k % 6 > 0, F.array("c_mktsegment")).alias("verification_warnings"),
    )
    return results.ops_page(rows).select("c_name", texts.fingerprint(F.col("page")).alias("page"))


def _claims_sql(n: str, said: str) -> str:
    return f"case when {n} > 0 then rtrim(repeat('- ' || {said} || chr(10), ({n})::int), chr(10)) when ok then '{results.NO_DATA}' else '{results.NOTHING_CHECKED}' end"


@query(f"""with s as (select *, c_custkey as k, c_custkey % 4 > 0 as ok from customer)
select c_name, sha256('# Проверка модуля: ' || c_name || E'\n\n## Вердикт\n' || case k % 3 when 0 then 'pass' else '{results.NO_DATA}' end || E'\n\n## Статус проверки\n- verifier_status: ' || case when ok then 'ok' when k % 8 = 0 then 'api_error' else 'None' end || E'\n- provider_status: null\n- structured_output_valid: ' ||
    case when k % 5 = 0 then 'None' when ok then 'True' else 'False' end || chr(10) || case when ok then '' else '{results.NOT_CHECKED}' end || E'\n\n## Unsupported claims\n' || {_claims_sql("k % 3", "c_mktsegment")} || E'\n\n## Weak claims\n' || {_claims_sql("k % 4", "c_mktsegment")}
    || E'\n\n## Missing uncertainty\n' || {_claims_sql("k % 2", "'part'")} || E'\n\n## Missing factual support\n' || {_claims_sql("0", "''")} || E'\n\n## Recommended fixes\n' || {_claims_sql("k % 5", "'because'")}
    || E'\n\n## Контекст проверки\n- context_source: plan\n- context_fingerprint: f' || k || case k % 3 when 0 then '' else rtrim(E'\n' || repeat('- ' || c_mktsegment || chr(10), (k % 3)::int), chr(10)) end || E'\n\n## Ошибки извлечения\n' || case when ok then '{results.NO_DATA}' else '- broken' end || E'\n') as page from s""")
def verification_pages(t):
    k, none, name = F.col("c_custkey"), F.lit(None).cast("string"), F.col("c_mktsegment")
    ok = k % 4 > 0
    claim = lambda said, why=none: F.struct(F.lit("part").alias("section"), said.alias("claim_text"), why.alias("reason"), F.lit("").alias("instruction"))
    many = lambda n, c: F.array_repeat(c, n.cast("int"))
    rows = t.customer.select(
        "c_name", F.col("c_name").alias("module"), F.when(k % 3 == 0, "pass").otherwise("").alias("verdict"), F.when(ok, "ok").when(k % 8 == 0, "api_error").alias("verifier_status"), none.alias("provider_status"), F.when(k % 5 > 0, ok).alias("structured_output_valid"),
        F.lit("plan").alias("context_source"), _text("f", k).alias("context_fingerprint"), many(k % 3, name).alias("factual_context_files"), F.when(~ok, F.array(F.lit("broken"))).alias("parse_errors"), many(k % 3, claim(name)).alias("unsupported_claims"),
        many(k % 4, claim(F.lit(""), name)).alias("weak_claims"), many(k % 2, claim(name)).alias("missing_uncertainty"), F.when(k < 0, many(k, claim(name))).alias("missing_factual_support"), many(k % 5, claim(name, F.lit("because"))).alias("recommended_fixes"),
    )
    return results.verification_page(rows).select("c_name", texts.fingerprint(F.col("page")).alias("page"))
