"""Paths, rows of undone work, summaries and pages of runs, as they must read."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import batch_results as results


@pytest.mark.parametrize(
    ("doc", "module", "enhanced", "checked"),
    [
        ("modules/a.md", "A", "r/modules/a.md", "v/a.verification.json"), ("\\modules\\a.b.md/", "A", "r/modules/a.b.md", "v/a.b.verification.json"), (None, "Core: x/y", "r/modules/module-core-x-y.md", "v/module-Core- x-y.verification.json"),
        ("../../x.md", "A", None, "v/x.verification.json"), ("", "", "r/modules/module-unknown.md", "v/module-unknown.verification.json"),
    ],
)
def test_paths_of_a_module(spark, doc, module, enhanced, checked):
    row = spark.createDataFrame([(doc, module)], "d string, m string").select(results.enhanced_path(F.lit("r"), F.col("d"), F.col("m")), results.verification_path(F.lit("v"), F.col("d"), F.col("m"))).first()
    assert tuple(row) == (enhanced, checked)


@pytest.mark.parametrize(("path", "beside"), [("r/modules/a.md", "r/llm-runs/a.metadata.json"), ("modules/a.b.md", "llm-runs/a.b.metadata.json"), ("r/modules/x/a.md", "r/modules/x/a.metadata.json"), ("a.md", "a.metadata.json")])
def test_metadata_lies_beside_modules(spark, path, beside):
    assert spark.createDataFrame([(path,)], "p string").select(results.metadata_path(F.col("p"))).first()[0] == beside


def test_recorded_paths(spark):
    rows = spark.createDataFrame([("/abs/x.md", "/p/docs/enhanced"), ("docs/a.md", "/p/docs/enhanced/"), ("docs/b.md", "/p/docs/enhanced"), ("docs/c.md", "/p/docs/enhanced"), ("docs/b.md", "/p/out"), ("", "/p"), (None, "/p")], "path string, root string")
    listing = spark.createDataFrame([("/p/docs/a.md",), ("/cwd/docs/a.md",), ("/cwd/docs/b.md",)], "path string")
    got = sorted(((r["path"], r["root"], r["resolved"]) for r in results.recorded_paths(rows, listing, "path", "root", "/cwd/").collect()), key=str)
    assert got == sorted([("/abs/x.md", "/p/docs/enhanced", "/abs/x.md"), ("docs/a.md", "/p/docs/enhanced/", "/p/docs/a.md"), ("docs/b.md", "/p/docs/enhanced", "/cwd/docs/b.md"), ("docs/c.md", "/p/docs/enhanced", "/p/docs/c.md"), ("docs/b.md", "/p/out", "/cwd/docs/b.md"), ("", "/p", None), (None, "/p", None)], key=str)


def test_work_that_was_not_done(spark):
    plan = spark.createDataFrame([("a", "modules/a.md", "full"), ("b", "modules/b.md", "full"), ("c", "modules/c.md", "skip"), ("d", "../d.md", "full"), ("e", "modules/e.md", "summary")], "module string, module_doc_path string, explain_mode string")
    written = spark.createDataFrame([("out/modules/a.md",), ("out/modules/c.md",)], "path string")
    got = {r["module"]: (r["status"], r["error"]) for r in results.unworked(plan, written, "out", required=("b",)).collect()}
    assert got == {"b": ("failed_preflight", "Enhanced markdown is missing: out/modules/b.md"), "c": ("skipped_by_plan", results.SKIPPED_BY_PLAN), "d": ("failed_preflight", "Enhanced output path escapes output root"), "e": ("skipped_missing_enhanced", None)}
    assert "c" not in {r["module"] for r in results.unworked(plan, written, "out", include_skip=True).collect()}


def test_finished(spark):
    rows = spark.createDataFrame([("generated", None, 1.23456), ("odd", "e", -2.0), (None, None, None)], "status string, error string, duration_seconds double")
    got = [tuple(r) for r in results.finished(rows, "generation").collect()]
    assert got == [("generated", None, 1.235), ("failed_generation", "Unsupported batch result status: odd", 0.0), ("failed_generation", "Unsupported batch result status: ", 0.0)]


def test_summaries_hide_secrets_and_count_failures(spark):
    manifests = spark.createDataFrame([("1", ["m key-1"], "2", 1, True), ("2", None, "x", 0, None)], "run_id string, selected_modules array<string>, failed_count string, failed_preflight_count int, network_call boolean")
    rows = spark.createDataFrame([("1", 1, "b", "generated", "key-1 reasoning_details"), ("1", 0, "a", "failed_x", ""), ("2", 0, None, "failed", None), ("2", 1, "z", "failed_y", None)], "run_id string, pos int, module string, status string, error string")
    got = {r["run_id"]: r for r in results.batch_summaries(manifests, rows, "generation", ("key-1",)).collect()}
    assert got["1"]["failed_total"] == 3 and got["1"]["selected_modules"] == ["m [redacted]"] and [tuple(x) for x in got["1"]["module_statuses"]] == [("a", "failed_x", None), ("b", "generated", "[redacted] [redacted-reasoning]")]
    assert got["2"]["failed_total"] == 2 and got["2"]["selected_modules"] == [] and [tuple(x) for x in got["2"]["module_statuses"]] == [("", "failed", None), ("z", "failed_y", None)]
    assert {r["run_id"]: r["failed_total"] for r in results.batch_summaries(manifests, rows, "verification").collect()} == {"1": 3, "2": 1}


def test_run_headers(spark):
    rows = spark.createDataFrame([("generation", "0", ["a", "b"], "true"), ("verification", "5", [], None), (None, None, None, "false")], "kind string, selected_modules_count string, selected_modules array<string>, latest_live_run string")
    got = [(r["selected_modules_count"], r["latest_live_run"], r["problem"]) for r in results.run_headers(rows, "generation", "run A").collect()]
    assert got == [(2, True, None), (5, False, "run A kind mismatch: expected generation, got verification"), (0, False, None)]


def test_ops_page(spark):
    counts = lambda kind: "struct<" + ",".join(f"{c}:int" for c in results.COUNTS[kind]) + ">"
    of = lambda k: f"latest_{k}_run_id string, latest_{k}_counts {counts(k)}, latest_{k}_usage_totals map<string,int>, latest_{k}_cache_hit_rate double, {k}_history_count int, {k}_warnings array<string>"
    row = ("g1", (1, 2, 3, None), {"total": 7, "prompt": None}, 0.25, 4, ["w", ""], None, None, None, None, None, ["v"])
    got = results.ops_page(spark.createDataFrame([row], f"{of('generation')}, {of('verification')}")).first()["page"]
    assert got.split("\n") == [
        "# Ops Summary", "", "## Latest generation run", "- run_id: g1", "- generated: 1", "- skipped_cached: 2", "- skipped_by_plan: 3", "- failed: 0", '- usage_totals: {"prompt": null, "total": 7}', "", "## Latest verification run", "нет данных", "",
        "## History counts", "- Generation: 4", "- Verification: 0", "", "## Cache effectiveness", "- Generation cache hit rate: 25.0%", "- Verification cache hit rate: нет данных", "", "## Recent warnings", "- w", "- v", "",
    ]


def test_verification_page(spark):
    claim = "array<struct<" + ",".join(f"{c}:string" for c in results.CLAIM_FIELDS) + ">>"
    schema = "module string, verdict string, verifier_status string, provider_status string, structured_output_valid boolean, context_source string, context_fingerprint string, factual_context_files array<string>, parse_errors array<string>, "
    schema += ", ".join(f"{c} {claim}" for c, _ in results.CLAIMS.values())
    good = ("m", "pass", "ok", '{"final": "ok"}', True, "plan", "f", ["a.md", "b.md"], [], [("s", "claim", "why", None), ("s", "", "why", None)], [], [("sec", None, "why", None)], None, [(None, None, None, None)])
    bad = ("n", None, None, None, None, None, None, [], ["broken"], None, None, None, None, None)
    a, b = (r["page"].split("\n") for r in results.verification_page(spark.createDataFrame([good, bad], schema)).collect())
    assert a == [
        "# Проверка модуля: m", "", "## Вердикт", "pass", "", "## Статус проверки", "- verifier_status: ok", '- provider_status: {"final": "ok"}', "- structured_output_valid: True", "", "", "## Unsupported claims", "- claim", "- why", "",
        "## Weak claims", "нет данных", "", "## Missing uncertainty", "- sec", "", "## Missing factual support", "нет данных", "", "## Recommended fixes", "нет данных", "", "## Контекст проверки", "- context_source: plan", "- context_fingerprint: f",
        "- a.md", "- b.md", "", "## Ошибки извлечения", "нет данных", "",
    ]
    assert b[6:12] == ["- verifier_status: None", "- provider_status: null", "- structured_output_valid: None", results.NOT_CHECKED, "", "## Unsupported claims"]
    assert b[12] == results.NOTHING_CHECKED and b[3] == "нет данных" and b[-3:] == ["## Ошибки извлечения", "- broken", ""] and b[-5] == "- context_fingerprint: None"
