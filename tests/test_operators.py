"""Small cases of operators: ties, NULLs, empty tables, orders."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import graph, pages, planning, quality, relations, resolve, runs, search, slugs


def test_diff_of_generations(spark):
    schema = "module string, status string, total_tokens long"
    a = spark.createDataFrame([("same", "ok", 1), ("changed", "ok", 10), ("removed", "ok", 1), ("null", None, None)], schema)
    b = spark.createDataFrame([("same", "ok", 1), ("changed", "failed", 4), ("added", "ok", 1), ("null", None, None)], schema)
    got = {r.module: r for r in runs.diff_runs(a, b, "module", ["status"], ["total_tokens"]).collect()}
    assert {k: r.change_status for k, r in got.items()} == {"same": "unchanged", "changed": "changed", "removed": "removed", "added": "added", "null": "unchanged"}
    assert got["changed"].total_tokens_delta == -6 and got["changed"].changed_fields == ["status", "usage.total_tokens"]
    assert runs.change_counts(runs.diff_runs(a, b, "module", ["status"])).first().asDict() == {"modules_added_count": 1, "modules_removed_count": 1, "modules_changed_count": 1, "modules_unchanged_count": 2}


def test_diff_of_verifications(spark):
    names = [*runs.VERIFICATION_FIELDS, *runs.ISSUE_COUNTS, *runs.USAGE]
    schema = "module string, " + ", ".join(f"{n} {'long' if n in runs.ISSUE_COUNTS + runs.USAGE else 'string'}" for n in names)

    def side(rows):
        return spark.createDataFrame([(m, *[{"verdict": v, "weak_claims_count": w}.get(n) for n in names]) for m, v, w in rows], schema)

    got = {r.module: r for r in runs.diff_verifications(side([("a", "fail", 2), ("b", "pass", 0), ("c", "warning", 1), ("d", "odd", 0)]), side([("a", " Warning", 1), ("b", "fail", 0), ("c", "warning", 1), ("d", "pass", 0)])).collect()}
    assert {k: r.verdict_direction for k, r in got.items()} == {"a": "improved", "b": "worsened", "c": "unchanged", "d": "unknown"}
    assert got["a"].weak_claims_count_delta == -1


def test_hit_rates(spark):
    got = spark.createDataFrame([(1, 4), (1, 2), (1, 0), (None, 3)], "a int, b int").select(runs.hit_rate(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r.r for r in got] == [0.25, 0.5, None, None]


def test_run_ids_and_latest(spark):
    rows = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "base string, t int")
    assert sorted(r.run_id for r in runs.unique_ids(rows, "base", ["t"]).collect()) == ["x", "x-2", "y"]
    assert {r.base: r.t for r in runs.latest(rows, ["base"], "t").collect()} == {"x": 2, "y": 1}


def test_plan_order_limit_and_skips(spark):
    rows = [("zeta", "high", "full"), ("alpha", "high", "summary"), ("beta", "medium", "full"), ("low", "low", "full"), ("skipme", "high", "skip")]
    plan = spark.createDataFrame([(*r, "detailed") for r in rows], "name string, priority string, explain_mode string, role string")
    chosen, skipped = planning.select_modules(plan, limit=3)
    assert [r.name for r in chosen.collect()] == ["zeta", "alpha", "beta"] and [r.name for r in skipped.collect()] == ["skipme"]
    assert planning.select_modules(plan, limit=0)[0].count() == 0
    with pytest.raises(ValueError, match="nobody"):
        planning.select_modules(plan, only=["zeta", "nobody"])


def test_only_tests_are_summed_up_not_skipped(spark):
    rows = spark.createDataFrame([("t", "test", 0, 0)], "name string, role string, entity_count int, dependency_count int")
    assert planning.plan_modules(rows).first().explain_mode == "summary"


def test_greedy_fill_passes_over_what_overflows(spark):
    docs = spark.createDataFrame([("m", 0, "x" * 40), ("m", 1, "x" * 400), ("m", 2, "x" * 8)], "module string, pos int, text string")
    got = planning.reduce_context(docs, "module", "pos", "text", 12).first()
    assert (got.kept, got.dropped) == ([0, 2], [1])


def test_sections_merge_repeated_headings(spark):
    docs = spark.createDataFrame([(1, "intro\n## A\nx\n## B\ny\n## A\nz")], "id int, text string")
    assert {r.heading: r.body for r in planning.markdown_sections(docs, "id", "text").collect()} == {"#": "intro", "A": "x\nz", "B": "y"}


def test_key_entities_order(spark):
    rows = [("helper", "function", "b.py", 20, False, "medium"), ("Service", "class", "a.py", 10, True, "high"), ("run", "function", "a.py", 5, True, "medium"), ("zeta", "method", "a.py", 1, None, None)]
    ents = spark.createDataFrame([("m", *r) for r in rows], "module string, name string, entity_type string, file string, line_start int, exported boolean, confidence string")
    assert [r.name for r in planning.top_entities(ents, "module").orderBy("rank").collect()] == ["Service", "run", "helper", "zeta"]


def test_slugs(spark):
    rows = spark.createDataFrame([("A b", "1"), ("a-B", "2"), ("a-B", "2"), ("", "3"), ("é", "4")], "name string, key string")
    got = slugs.assign_slugs(rows, F.col("name"), F.col("key"))
    names = sorted(r.slug for r in got.collect())
    assert len(set(names)) == 5 and slugs.colliding(got).count() == 0
    assert sum(n.startswith("a-b-") for n in names) == 3 and sum(n.startswith("item") for n in names) == 2


def test_reachability_on_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("z",)], "seed string")
    assert sorted((r.seed, r.node, r.hops) for r in graph.reachable(seeds, edges).collect()) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("z", "z", 0)]


def test_long_chain(spark):
    edges = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.reachable(spark.createDataFrame([(0,)], "seed long"), edges).count() == 41


def test_reachability_is_the_same_in_rounds(spark):
    import random

    r = random.Random(5)
    edges = spark.createDataFrame([(r.randrange(60), r.randrange(60)) for _ in range(80)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (7, 7)], "src long, dst long")
    seeds = spark.createDataFrame([(0,), (7,), (100,), (999,), (7,)], "seed long")
    told = sorted(map(tuple, graph.reachable(seeds, edges).collect()))
    assert sorted(map(tuple, graph.reachable(seeds, edges, small=0).collect())) == told and (100, 140, 40) in told
    for small in (0, 1000):
        with pytest.raises(Exception, match="not all nodes"):
            graph.reachable(seeds, edges, max_hops=9, small=small).collect()


def test_joined_paths(spark):
    rows = spark.createDataFrame([("a/b", "../c.js"), (".", "./x"), ("a", "../../x"), ("a", "./b/./c")], "d string, r string")
    assert [r.p for r in rows.select(resolve.joined_path(F.col("d"), F.col("r")).alias("p")).collect()] == ["a/c.js", "x", None, "a/b/c"]


def test_nearest_root(spark):
    rows = spark.createDataFrame([("a/b/c.py",), ("x.py",)], "path string")
    roots = spark.createDataFrame([("a",), ("a/b",)], "root string")
    assert {r.path: r.root for r in resolve.nearest_root(rows, roots, ["path"]).collect()} == {"a/b/c.py": "a/b", "x.py": None}


def test_problems(spark):
    rows = spark.createDataFrame([("alpha", "warning", True, True, 1), ("beta", "pass", True, True, 0), ("missing", None, False, False, None)], "module string, verdict string, enhanced_present boolean, verified boolean, weak_claims_count long")
    got = {r.module: (r.problem_types, r.severity) for r in quality.module_problems(rows).collect()}
    assert got == {"alpha": (["verification_warning"], "warning"), "missing": (["missing_enhanced", "missing_verification"], "info")}
    summary = quality.problem_summary(rows).first()
    assert (summary.status, summary.modules_with_warnings, summary.modules_missing_enhanced, summary.weak_claims_total) == ("partial", 1, 1, 1)
    assert quality.problem_summary(rows.limit(0)).first().status == "no_data"


def test_references(spark):
    got = spark.range(1).select(quality.allowed_references(F.array(F.lit("docs/generated/a"), F.lit("b"), F.lit("a")), F.array(F.lit("a"))).alias("x")).first()
    assert got.x == ["a"]


def test_search_facets(spark):
    rows = search.records(spark.createDataFrame([("Alpha", "t1"), ("alphabet", "t2"), ("other", "t1")], "t string, k string"), "module", title=F.col("t"), type=F.col("k"), entity_id=F.col("t"))
    assert [(r.title, r["rank"]) for r in search.ranked(search.search(rows, " ALPHA ")).collect()] == [("Alpha", 0), ("alphabet", 1)]
    assert search.search(rows, type="t1").count() == 2 and search.search(rows, run_id="x").count() == 0
    with pytest.raises(ValueError):
        search.search(rows, colour="red")


def test_unique_matches_need_one_partner(spark):
    left = spark.createDataFrame([("a",), ("b",)], "k string")
    right = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "k string, v int")
    assert [tuple(r) for r in relations.unique_matches(left, right, ["k"]).collect()] == [("a", 1)]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.tokens(F.lit("abcde"))) == 2 and one(text.safety_margin(F.lit(10_000))) == 3500
    assert one(text.truncated(F.lit("ab\ncdef\ngh"), 8)) == "ab\ncdef" + text.TRUNCATION_MARK
    assert one(text.cell(F.lit("alpha | beta\nsecond line"))) == "alpha \\| beta<br>second line"
    assert one(text.cache_key(b=F.lit(1), a=F.lit(None))) == one(F.sha2(F.lit('{"a":null,"b":1}'), 256))
    assert one(text.unfenced(F.lit("```md\n# x\n```"))) == "# x"
    assert one(text.int_or_zero(F.lit("x"))) == 0 and one(text.truthy(F.lit(" Yes")))
    assert one(text.provider_status(F.lit("401 Unauthorized"))) == "auth_error" and one(text.provider_status(F.lit("?"))) == "api_error"
    assert one(text.utc_time(F.lit("nonsense"))) is None
    assert one(text.missing_sections(F.array(F.lit("A")), ("A", "B"))) == ["B"]


def test_key_files(spark):
    rows = spark.createDataFrame([("m", ["a"], ["b", "c"])], "name string, source_files array<string>, test_files array<string>")
    assert sorted(tuple(r) for r in pages.key_files(rows, ["source_files", "test_files"]).collect()) == [("m", "source_files", "a"), ("m", "test_files", "b"), ("m", "test_files", "c")]
