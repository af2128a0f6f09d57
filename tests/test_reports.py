"""Nested roots, numbers, JSON in texts, varying shapes, schemas, attempts and cuts, against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import json_text, variants
from factloom.operators import attempts, ledger, numbering, schema_check, scoped


def _raw(text):
    decoder = json.JSONDecoder()
    for i, c in enumerate(text or ""):
        if c == "{":
            try:
                return i, decoder.raw_decode(text, i)[1]
            except ValueError:
                pass
    return None


def _first(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", json_text.first_object(F.col("t")).alias("s")).collect()
    return [None if r["s"] is None else tuple(r["s"]) for r in sorted(rows, key=lambda r: r["i"])]


def test_first_object_like_a_decoder(spark):
    r = random.Random(4)
    # no brace stands inside a string of these, unless the object around it is whole
    bits = ["{", "}", "[", "]", ":", ",", '"a"', '"a":1', '{"b":[1,2,{"c":"}"}]}', '\\"', "x", " ", "\n", "null", "true", "1.5e3", "01", "-", "é", "{}", "[]", '"\\u00e9"', "NaN", '{"k": "v{"}']
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(1, 12))) for _ in range(1500)]
    texts = [t for t in texts if '"{' not in t and '"[{' not in t] + [None, "", "no", 'see {x} {"a": {"b": [1, "}"]}, "c": -1.5} tail }', '{"a": {"b": 1}', '{"a":1}{"b":2}', '{"a": "line\nbreak"} {}', '{"😀": "é"} 😀']
    got, want = _first(spark, texts), [_raw(t) for t in texts]
    assert sum(w is not None for w in want) > 300
    odd = [(t, g, w) for t, g, w in zip(texts, got, want, strict=True) if g != w and not (w and g != w and t[: w[0]].count('"') % 2)]
    assert odd == []


def test_first_object_of_long_texts(spark):
    big = '{"a": [' + ", ".join('{"k%d": "v\\"{%d}"}' % (i, i) for i in range(30_000)) + "]}"
    assert _first(spark, ["x" * 100_000 + big + " tail", big[:-1], "{" * 20_000, "y" * 500_000]) == [(100_000, 100_000 + len(big)), (7, 23), None, None]


@pytest.mark.parametrize(
    ("text", "status", "payload"),
    [
        (None, "empty_content", None), (" \n", "empty_content", None), ("words", "provider_response_mismatch", None), ("} {", "provider_response_mismatch", None), ('{"a": 1}', "ok", '{"a": 1}'),
        ('```json\n{"a": 1}\n```', "ok", '{"a": 1}'), ('```\n{"a": 1}', "ok", '{"a": 1}'), ('so {"a": 1} it is', "ok", '{"a": 1}'), ('{"a": 1} {"b": 2}', "parse_failure", None), ("{a: 1}", "parse_failure", None),
    ],
)
def test_responses(spark, text, status, payload):
    row = spark.createDataFrame([(text,)], "t string").select(json_text.parsed_response(F.col("t")).alias("r")).first()["r"]
    assert (row["status"], row["payload"]) == (status, payload)


def test_keys_go_at_any_depth(spark):
    def dropped(x):
        if isinstance(x, dict):
            return {k: dropped(v) for k, v in x.items() if k != "reasoning_details"}
        return [dropped(v) for v in x] if isinstance(x, list) else x

    r = random.Random(3)

    def made(depth):
        k = r.randrange(7 if depth else 4)
        if k < 4:
            return r.choice([1, 'a"b', '{,"reasoning_details":1}', None, True, 1.5, "x\\"])
        return [made(depth - 1) for _ in range(r.randrange(4))] if k == 4 else {r.choice(["a", "b", "reasoning_details", "zz"]): made(depth - 1) for _ in range(r.randrange(5))}

    values = [made(4) for _ in range(600)]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, t string").select("i", variants.cleaned(F.parse_json("t")).alias("c")).collect()
    assert all(json.loads(x["c"]) == dropped(values[x["i"]]) for x in rows)


def test_contents_of_varying_shape(spark):
    cases = {
        '"hi"': ("hi", None), '{"a":1,"reasoning_details":[1]}': ('{"a":1,"reasoning_details":[1]}', '{"a":1}'), "null": ("", None), "3": ("3", None), "[]": ("", None), '""': ("", None),
        '[{"text":"one"},{"json":"{\\"q\\": [1]}"},"two","",{"x":1},5,null,{"text":null,"parsed":{"z":1}}]': ('one\n{"q":[1]}\ntwo\n{"x":1}\n5\n{"z":1}', '{"q":[1]}'),
        '[{"json":null,"parsed":{"z":1}}]': ('{"json":null,"parsed":{"z":1}}', None), '[{"output_json":"plain"}]': ('"plain"', '"plain"'),
    }
    df = spark.createDataFrame([(c,) for c in cases], "t string").withColumn("v", F.parse_json("t"))
    got = {r["t"]: (r["m"], r["s"]) for r in df.select("t", variants.message_text(F.col("v")).alias("m"), variants.structured_content(F.col("v")).alias("s")).collect()}
    assert got == cases
    parsed = spark.createDataFrame([("{}", '{"p":1,"reasoning_details":2}'), ('{"a":1}', "null")], "t string, p string")
    assert [r[0] for r in parsed.select(variants.structured_content(F.parse_json("t"), F.parse_json("p"))).collect()] == ['{"p":1}', '{"a":1}']


def _plain_errors(payload):
    if not isinstance(payload, dict):
        return [schema_check.NOT_PARSED]
    out = []
    for f in schema_check.LIST_FIELDS:
        if f not in payload:
            out.append(f"Missing expected field: {f}.")
        elif not isinstance(payload[f], list):
            out.append(f"Expected field to be a list: {f}.")
        else:
            out += [f"Expected {f}[{i}] to be an object." for i, x in enumerate(payload[f]) if not isinstance(x, dict)]
    if str(payload.get("verdict") or "").strip().lower() not in ("pass", "warning", "fail"):
        out.append("Missing or invalid verdict.")
    claims = payload.get("unsupported_claims")
    return out + ["Unsupported claim severity must be high, medium, or low." for x in (claims if isinstance(claims, list) else []) if isinstance(x, dict) and str(x.get("severity", "")).lower() not in ("high", "medium", "low")]


def test_payloads_against_the_schema(spark):
    r = random.Random(9)
    claim = lambda: r.choice([{}, {"severity": "HIGH"}, {"severity": "odd", "x": [1]}, {"severity": None}, 1, "s", None, [1]])
    payloads = [None, [], 5, {}]
    for _ in range(150):
        p = {f: r.choice([[claim() for _ in range(r.randrange(13))], [], "none", {"a": 1}]) for f in schema_check.LIST_FIELDS if r.random() < 0.8}
        payloads.append(p | r.choice([{}, {"verdict": "Pass "}, {"verdict": "odd"}, {"verdict": 3}, {"extra": {"verdict": "pass"}}]))
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)] + [(-1, "no JSON"), (-2, None)], "id int, t string")
    got = {x["id"]: x["errors"] for x in schema_check.schema_errors(df.select("id", F.try_parse_json("t").alias("payload"))).collect()}
    assert got == {-1: [schema_check.NOT_PARSED], -2: [schema_check.NOT_PARSED]} | {i: _plain_errors(p) for i, p in enumerate(payloads)}


def test_nested_rules(spark):
    rules = (schema_check.Rule("a[].b.c", "string", absent="no {field} at {at}", wrong="bad {at}"),)
    df = spark.createDataFrame([(1, '{"a": [{"b": {"c": "x"}}, {"b": {}}, {"b": {"c": 1}}, {}]}')], "id int, t string").select("id", F.parse_json("t").alias("payload"))
    assert schema_check.schema_errors(df, rules).first()["errors"] == ["no a[].b.c at a[1].b.c", "bad a[2].b.c"]


def test_attempts_end_as_the_table_says(spark):
    rows = [("a", 1, "ok"), ("a", 2, "parse_failure"), ("b", 2, "ok"), ("b", 1, " empty_content "), ("c", 1, "schema_rejected"), ("d", 1, "what?"), ("d", 2, "ok"), ("e", 1, "parse_failure"), ("e", 2, "parse_failure"), ("e", 3, "ok"), ("f", 1, None)]
    got = {r[0]: tuple(r)[1:] for r in attempts.provider_status(spark.createDataFrame(rows, "m string, n int, s string"), "m", "n", "s").collect()}
    assert got == {
        "a": (1, "ok", None, False, None, "ok"), "b": (2, "empty_content", "ok", True, "empty_content", "ok"), "c": (1, "schema_rejected", None, False, None, "schema_rejected"), "d": (1, "api_error", None, False, None, "api_error"),
        "e": (2, "parse_failure", "parse_failure", True, "parse_failure", "parse_failure"), "f": (1, "api_error", None, False, None, "api_error"),
    }


def test_status_of_one_attempt(spark):
    df = spark.createDataFrame([("ok", [], None), ("ok", ["x"], None), ("parse_failure", [], None), ("ok", [], "auth_error")], "p string, e array<string>, x string")
    assert [r[0] for r in df.select(attempts.status_of(F.col("p"), F.col("e"), F.col("x"))).collect()] == ["ok", "structured_output_invalid", "parse_failure", "auth_error"]


def test_cuts_replay_from_the_ledger(spark):
    text = "\n".join(f"line {i} of many" for i in range(800))
    docs = spark.createDataFrame([(1, "dependency-map.md", text), (2, "files/file-x.md", "z" * 3000), (3, "notes.md", text), (4, "module-map.md", "short"), (5, "files\\index.md", text), (6, "files/index.md", "")], "id int, path string, text string")
    made = ledger.reduced(docs)
    kept = {r["id"]: (len(r["content"]), r["cut"]) for r in made.collect()}
    assert [kept[i][1] is None for i in range(1, 7)] == [False, False, True, True, False, True]
    assert kept[1][1]["retained_chars"] == kept[1][0] <= 6000 + len("\n\n[truncated]") and kept[2][0] == 2500 + len("\n\n[truncated]")
    table = made.select("id", "path", "cut")
    assert all(r["same"] for r in ledger.replayed(docs, table, ["id"]).collect())
    changed = docs.withColumn("text", F.when(F.col("id") == 1, F.concat(F.lit("new "), "text")).otherwise(F.col("text"))).filter("id != 5")
    assert {r["id"]: r["same"] for r in ledger.replayed(changed, table, ["id"]).collect()} == {1: False, 2: True, 3: True, 4: True, 5: False, 6: True}


def test_cut_longer_than_the_original_is_replayed(spark):
    docs = spark.createDataFrame([(n, "files/file-x.md", "z" * n) for n in (2500, 2501, 2512, 2513, 2514)], "id int, path string, text string")
    made = ledger.reduced(docs)
    again = {r["id"]: (r["content"], r["same"]) for r in ledger.replayed(docs, made.select("id", "path", "cut"), ["id"]).collect()}
    assert again == {r["id"]: (r["content"], True) for r in made.collect()}
    assert [len(again[n][0]) for n in sorted(again)] == [2500, 2513, 2513, 2513, 2513]


def test_roots_give_names_of_their_own(spark):
    files = ["a/pyproject.toml", "a/util.py", "a/app.py", "a/pkg/__init__.py", "a/pkg/mod.py", "a/b/setup.py", "a/b/util.py", "a/b/app.py", "c/app.py", "top.py", "c/deep/top.py", "a/data.json"]
    table = spark.createDataFrame([(f,) for f in files], "path string")
    roots = spark.createDataFrame([("a",), ("a/b",)], "root string")
    cases = [
        ("a/app.py", "import", "util", None, 0, [], [("util", "a/util.py", "internal")]), ("a/b/app.py", "import", "util", None, 0, [], [("util", "a/b/util.py", "internal")]),
        ("a/b/app.py", "import", "pkg.mod", None, 0, [], [("pkg.mod", "a/pkg/mod.py", "internal")]), ("c/app.py", "import", "util", None, 0, [], [("util", None, "unresolved")]),
        ("c/app.py", "import", "top", None, 0, [], [("top", "top.py", "internal")]), ("c/app.py", "import", "c.deep", None, 0, [], [("c.deep", None, "internal")]),
        ("a/b/app.py", "from", "", "pkg", 0, ["mod", "other"], [("pkg.mod", "a/pkg/mod.py", "internal")]), ("a/b/app.py", "from", "", "pkg", 0, ["other"], [("pkg", "a/pkg/__init__.py", "internal")]),
        ("a/pkg/mod.py", "from", "", None, 1, ["mod"], [("a.pkg.mod", "a/pkg/mod.py", "internal")]), ("top.py", "from", "", None, 1, ["x"], [(".", None, "internal")]),
        ("c/app.py", "import", "os.path", None, 0, [], [("os.path", None, "stdlib")]), ("c/app.py", "import", "requests.x", None, 0, [], [("requests.x", None, "third_party")]), ("a/app.py", "import", "pkg.none", None, 0, [], [("pkg.none", None, "internal")]),
    ]
    imports = spark.createDataFrame([(i, c[0], c[1], c[2], c[3], c[4], c[5], 1, "python") for i, c in enumerate(cases)], "id int, source_file string, import_kind string, imported string, module string, level int, names array<string>, line_start int, language string")
    declared = spark.createDataFrame([("python", "requests")], "ecosystem string, normalized_name string")
    got: dict = {}
    for r in scoped.resolve_python(imports, table, roots, declared, ["os"]).collect():
        got.setdefault(r["id"], []).append((r["imported"], r["resolved_file"], r["dependency_type"]))
    assert got == {i: c[-1] for i, c in enumerate(cases)}


def test_numbers_without_one_task(spark):
    rows = spark.range(0, 3000, 1, 7).select(F.col("id").alias("i"), F.when(F.col("id") % 5 != 0, F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 3001).alias("k"))
    all_ = numbering.numbered(rows, F.col("k").desc(), first=0)
    assert [r["k"] for r in sorted(all_.collect(), key=lambda r: r["number"])] == sorted((r["k"] for r in rows.collect()), reverse=True)
    assert sorted(r["number"] for r in all_.collect()) == list(range(3000))
    within = numbering.numbered(rows, "k", by=("g",)).collect()
    for g in (None, 0, 1, 2):
        own = sorted((r["k"], r["number"]) for r in within if r["g"] == g)
        assert [n for _, n in own] == list(range(1, len(own) + 1))
    for df in (all_, numbering.numbered(rows, "k", by=("g",))):
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()
    assert numbering.numbered(rows.limit(0), "k").collect() == [] == numbering.numbered(rows.limit(0), "k", by=("g",)).collect()


def test_problems_by_module(spark):
    from factloom.operators import quality

    modules = spark.createDataFrame([("a", "pass", True, True), ("b", "warning", True, True), ("c", None, False, False), ("d", "pass", True, True)], "module string, verdict string, enhanced_present boolean, verified boolean")
    reports = spark.createDataFrame([("a", [("s",)], []), ("b", [], [("s",), ("t",)]), ("gone", [("s",)], [("s",)]), ("d", [], None)], "module string, weak_claims array<struct<section string>>, unsupported_claims array<struct<section string>>")
    got = {r["module"]: tuple(r)[1:] for r in quality.problems_by_module(modules, reports).collect()}
    assert got == {"a": ([], "warning", 1, 0), "b": (["verification_warning"], "fail", 0, 2), "c": (["missing_enhanced", "missing_verification"], "info", 0, 0)}
