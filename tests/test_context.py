"""Context bundles against a plain walk over the documents, and plans of modules whose pages are where manifests, slugs or nobody says."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import context

TARGET = "project string, module string, module_doc_path string, module_doc_exists boolean, file_docs array<struct<source_file:string,doc_path:string,exists:boolean>>"
TEXTS = "project string, path string, text string"


def _tokens(n):
    return (n + 3) // 4


def _cut(text, limit):
    if limit is None or len(text) <= limit:
        return text
    head = text[:limit]
    return (head.rsplit("\n", 1)[0] if "\n" in head else head).rstrip() + "\n\n[truncated]"


def _bundle(docs, prompt, index):
    """docs: (label, path, text). The context, its files and three estimates."""
    parts = [f"### {label}: {path}\n{text.strip()}" for label, path, text in docs]
    files = [path for _, path, _ in docs]
    if index:
        parts.append(f"### function_index_summary\nFunction index available as navigation-only context: {index}. Use it only as a summary/link source.")
        files.append(index)
    whole = "\n\n".join(parts).strip()
    n = _tokens(prompt + len(whole) + len(json.dumps(files, ensure_ascii=False, indent=2)))
    return whole, files, (_tokens(len(whole)), n, n + max(512, -(-n * 35 // 100)))


def _limit(label):
    return 2500 if label.startswith("file_doc:") else {"dependency_map": 6000}.get(label)


def _expected(docs, prompt, index, limit):
    whole, files, before = _bundle(docs, prompt, index)
    if not (limit > 0 and before[2] > limit):
        return {"required": False, "applied": False, "retained": files, "dropped": [], "truncated": [], "text": whole, "before": before, "after": before}
    cut = [(label, path, _cut(text, _limit(label))) for label, path, text in docs]
    kept = [d for d in cut if d[0] in context.KEPT]
    for d in cut:
        if d[0].startswith("file_doc:") and _bundle([*kept, d], prompt, index)[2][2] <= limit:
            kept.append(d)
    whole, files, after = _bundle(kept, prompt, index)
    was = {p: t for _, p, t in docs}
    truncated = [(p, len(was[p]), len(t)) for _, p, t in kept if t != was[p]]
    dropped = sorted(p for _, p, _ in docs if p not in [k[1] for k in kept])
    return {"required": True, "applied": bool(dropped or truncated), "retained": [f for f in files if f not in [t[0] for t in truncated]], "dropped": dropped, "truncated": truncated, "text": whole, "before": before, "after": after}


def _made(r):
    """Made-up projects: (target rows, texts, the documents of each module in order, prompts)."""
    words = ["один", "two", "\n", "  ", "x" * 40, "é", "\t", "line\n"]
    text = lambda n: "".join(r.choice(words) for _ in range(n))
    targets, texts, asked, prompts = [], {}, {}, []
    for project in ("p", "q", "bare"):
        if project != "bare":
            for name in context.TAKEN:
                texts[project, context.GLOBAL_DOCS[name]] = text(r.choice([0, 30, 900]))
        for m in range(25):
            key = (project, f"m{m}")
            docs = []
            page = f"modules/m{m}.md" if r.random() < 0.8 else ""
            if page:
                texts[project, page] = text(r.choice([0, 5, 200]))
                docs.append(("module_doc", page, texts[project, page]))
            docs += [(n, context.GLOBAL_DOCS[n], texts[project, context.GLOBAL_DOCS[n]]) for n in context.TAKEN if project != "bare"]
            files = []
            for f in range(r.randrange(9)):
                path, there = f'files/"{m}"-é{f}.md', r.random() < 0.85
                if there:
                    texts[project, path] = r.choice([text(r.choice([1, 50, 400])), "   \n"])
                    docs.append((f"file_doc:src/{f}.py", path, texts[project, path]))
                files.append((f"src/{f}.py", path, there))
            targets.append((*key, page, bool(page), files))
            index = r.choice([None, "functions/function-index.md"])
            prompts.append((*key, r.randrange(5000), index))
            asked[key] = (docs, prompts[-1][2], index)
    return targets, [(*k, t) for k, t in texts.items()], asked, prompts


@pytest.mark.parametrize("limit", [0, 1500, 4000, 24_000])
def test_bundles_like_a_plain_walk(spark, limit):
    targets, texts, asked, prompts = _made(random.Random(7))
    texts = spark.createDataFrame(texts, TEXTS)
    globals_ = context.global_documents(spark.createDataFrame([("p",), ("q",), ("bare",)], "project string"), texts)
    docs = context.context_documents(spark.createDataFrame(targets, TARGET), globals_, context.measured(texts))
    decided = context.reductions(docs, spark.createDataFrame(prompts, "project string, module string, prompt_chars int, function_index string"), limit)
    rows = context.bundles(decided, texts).withColumn("meta", context.reduction_metadata()).collect()
    assert len(rows) == len(asked)
    required = 0
    for r in rows:
        want = _expected(*asked[r["project"], r["module"]], limit)
        got = {k: r[k] for k in ("required", "applied", "retained", "dropped")} | {"truncated": [(x["path"], x["original_chars"], x["retained_chars"]) for x in r["truncated"]], "text": r["context_text"], "before": tuple(r["before"]), "after": tuple(r["after"])}
        assert got == want, (r["project"], r["module"])
        assert r["context_fingerprint"] == hashlib.sha256(want["text"].encode()).hexdigest() == r["meta"]["context_fingerprint"]
        required += r["required"]
    assert required > 5 or limit in (0, 24_000)


def test_documents_that_stop_a_prompt(spark):
    bad = [("p", "a", "../secret.md", True, []), ("p", "b", "modules/b.md", True, [("x.py", "files/gone.md", True)]), ("p", "c", "modules/b.md", True, []), ("p", "d", "", False, None)]
    texts = spark.createDataFrame([("p", "modules/b.md", "b"), ("p", "../secret.md", "s")], TEXTS)
    globals_ = context.global_documents(texts, texts)
    docs = context.context_documents(spark.createDataFrame(bad, TARGET), globals_, context.measured(texts))
    assert {r["module"]: r["problems"] for r in context.refused(docs).collect()} == {"a": ["escapes: ../secret.md"], "b": ["missing: files/gone.md"]}
    prompts = spark.createDataFrame([("p", m, 10, None) for m in "abcd"], "project string, module string, prompt_chars int, function_index string")
    got = {r["module"]: r["context_text"] for r in context.bundles(context.reductions(docs, prompts), texts).collect()}
    assert got == {"c": "### module_doc: modules/b.md\nb", "d": ""}


@pytest.mark.parametrize(("path", "out"), [("a/b.md", False), ("a/../b.md", False), ("../a.md", True), ("a/../../b/c.md", True), ("a\\..\\..\\c", True), ("/etc/x", True), ("C:\\x", True), ("./a", False), ("", False)])
def test_paths_that_escape(spark, path, out):
    assert spark.createDataFrame([(path,)], "p string").select(context.escapes(F.col("p"))).first()[0] is out


def test_pages_by_manifest_or_slug(spark):
    entries = spark.createDataFrame([("p", 0, "a", "./files/a.md"), ("p", 1, "a", "files\\a2.md"), ("p", 2, "", "x.md"), ("p", 3, "b", " "), ("p", 4, None, None)], "project string, place int, key string, doc_path string")
    sections = spark.createDataFrame([("p",), ("r",)], "project string")
    slugged = spark.createDataFrame([("p", "b", "files/b.md"), ("q", "a", "files/a.md"), ("r", "a", "files/a.md"), ("s", "a", "files/a.md")], "project string, key string, doc_path string")
    listing = spark.createDataFrame([("p", "files/a2.md"), ("q", "files/x.md"), ("s", "files/a.md"), ("s", "files/a.md")], "project string, path string")
    got = {tuple(r) for r in context.effective_paths(entries, sections, slugged, listing).collect()}
    assert got == {("p", "a", "files/a2.md", True, True), ("q", "a", "files/a.md", False, False), ("s", "a", "files/a.md", True, False)}


def test_targets_say_what_is_missing(spark):
    modules = spark.createDataFrame(
        [("p", "core", "package", "full", 3, 2, ["a.py", "b.py", "a.py"], ["t.py"], ["w"]), ("p", "tests", "fixture", "skip", 0, 0, ["c.py"], None, None), ("p", "lost", "", "summary", 1, 0, [], [], [])],
        "project string, module string, type string, explain_mode string, entity_count int, dependency_count int, source_files array<string>, test_files array<string>, warnings array<string>",
    )
    listing = spark.createDataFrame([("p", "modules/core.md", "m" * 100), ("p", "files/a.md", "a" * 50), ("p", "dependency-map.md", "d" * 10), ("p", "functions/function-index.md", "f" * 5000), ("p", "architecture.md", "x" * 999)], TEXTS)
    paths = "project string, key string, doc_path string, exists boolean, listed boolean"
    module_paths = spark.createDataFrame([("p", "core", "modules/core.md", True, True), ("p", "tests", "modules/tests.md", False, True)], paths)
    file_paths = spark.createDataFrame([("p", "a.py", "files/a.md", True, True), ("p", "b.py", "files/b.md", False, True), ("p", "t.py", "files/t.md", False, True)], paths)
    facts = spark.createDataFrame([("p", "a.py"), ("p", "b.py"), ("p", "b.py"), ("p", "c.py")], "project string, file string")
    globals_ = context.global_documents(modules, listing)
    got = {r["module"]: r for r in context.module_targets(modules, module_paths, file_paths, facts, globals_, context.measured(listing)).collect()}
    core, tests, lost = got["core"], got["tests"], got["lost"]
    assert core["estimated_input_tokens"] == _tokens(100 + 50 + 10 + 1200 + 3200) and core["budget_status"] == "ok" and core["context_reduction_reason"] is None
    assert [tuple(x) for x in core["file_docs"]] == [("a.py", "files/a.md", True), ("b.py", "files/b.md", False), ("t.py", "files/t.md", False)]
    assert core["warnings"] == ["missing file doc: files/b.md", "w"] and core["missing_context"] == ["file_doc_missing:b.py"]
    assert core["context_paths"] == ["dependency-map.md", "files/a.md", "functions/function-index.md", "modules/core.md"] and core["planned_output_path"] == "docs/enhanced/modules/core.md"
    assert tests["warnings"] == ["analysis_render_mismatch: missing file page for c.py"] and tests["missing_context"] == [] and tests["estimated_input_tokens"] == _tokens(10 + 1200 + 1200)
    assert lost["warnings"] == ["analysis_render_mismatch: missing module page for lost (unknown)"] and lost["missing_context"] == ["module_doc_missing"]
    assert lost["planned_output_path"] == "docs/enhanced/modules/module-unknown-lost.md" and lost["file_docs"] == []
    missing = context.missing_documents(globals_, listing).first()["warnings"]
    assert missing == ["missing docs entry: coverage-report.md", "missing docs entry: files/index.md", "missing docs entry: module-map.md"]
