"""Whole pages as they must read, their one shuffle, and the sink that writes them."""

import json
import re

import pytest
from pyspark.sql import functions as F

from factloom.operators import documents
from factloom.sources import page_sink

ENTITY = "file string, name string, line_start int, entity_type string, type string, `parent/container` string, signature string, parameters string, return_annotation string, is_async boolean, exported boolean, `docstring/jsdoc` string, confidence string"


def _file_pages(spark):
    files = spark.createDataFrame([("a.py",), ("b.py",)], "path string")
    entities = spark.createDataFrame(
        [("a.py", "g", 9, "function", None, "K", "g(x | y)", "x", None, False, True, "one\ntwo", "high"), ("a.py", "f", 2, "function", None, None, "f()", "", "int", True, False, None, "low"), ("gone.py", "h", 1, *[None] * 10), (None, "n", 1, *[None] * 10)], ENTITY
    )
    imports = spark.createDataFrame([("b.py", 1, "os", "stdlib", None), ("b.py", 2, "a", "internal", "a.py")], "source_file string, line_start int, imported string, dependency_type string, resolved_file string")
    members = spark.createDataFrame([("a.py", "M", "m-1", "package", None), ("a.py", "L", "l", "", "test")], "file string, name string, slug string, type string, role string")
    return documents.file_pages(files, entities, imports, members)


def test_file_pages(spark):
    got = {r["path"]: r["page"] for r in _file_pages(spark).collect()}
    assert got == {
        "a.py": "\n".join([
            "# Файл: a.py", "", "## Сущности", "", "| name | entity_type | type | parent/container | signature | parameters | return_annotation | is_async | exported | docstring/jsdoc | confidence |",
            "| --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- |", "| f | function | нет данных | нет данных | f() | нет данных | int | true | false | нет данных | low |",
            "| g | function | нет данных | K | g(x \\| y) | x | нет данных | false | true | one<br>two | high |", "", "## Импорты", "", "нет данных", "", "## Участвует в модулях", "",
            "- [L](../modules/l.md) (`unknown`, `test`)", "- [M](../modules/m-1.md) (`package`, `unknown`)", "",
        ]),
        "b.py": "\n".join([
            "# Файл: b.py", "", "## Сущности", "", "нет данных", "", "## Импорты", "", "| imported | dependency_type | resolved_file |", "| --- | --- | --- |", "| a | internal | a.py |", "| os | stdlib | нет данных |", "",
            "## Участвует в модулях", "", "нет данных", "",
        ]),
    }


def test_pages_take_one_shuffle(spark):
    plan = _file_pages(spark)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?m)\bExchange hashpartitioning", plan.split("== Initial Plan ==")[0])) == 1


def test_sections_of_empty_tables(spark):
    none = spark.createDataFrame([], "path string")
    assert documents.assembled([documents.fixed(none, F.col("path"), {0: ["x"]})]).collect() == []


def _rows(spark, *rows):
    return spark.createDataFrame(rows, "path string, page string").repartition(3)


def test_pages_are_replaced_and_kept(spark, tmp_path):
    root = str(tmp_path / "docs")
    assert page_sink.write_pages(_rows(spark, ("a/x.md", "1"), ("b.md", "é\n2"), ("c/d/e.md", "5")), root, {"renderer_version": "1"}) == ["a/x.md", "b.md", "c/d/e.md"]
    (tmp_path / "docs" / "own.md").write_text("mine")
    told = json.loads((tmp_path / "docs" / page_sink.MANIFEST).read_text())
    assert told == {"renderer_version": "1", "generated_files": ["a/x.md", "b.md", "c/d/e.md"], "generated_file_count": 3}
    assert (tmp_path / "docs" / "b.md").read_text() == "é\n2"
    assert page_sink.write_pages(_rows(spark, ("b.md", "3"), ("c/f.md", "4")), root) == ["b.md", "c/f.md"]
    assert sorted(str(p.relative_to(tmp_path / "docs")) for p in (tmp_path / "docs").rglob("*") if p.is_file()) == ["b.md", "c/f.md", page_sink.MANIFEST, "own.md"]
    assert not (tmp_path / "docs" / "a").exists() and (tmp_path / "docs" / "b.md").read_text() == "3"


@pytest.mark.parametrize("path", ["../x", "/x", "a/../../x", "C:\\x", "\\\\host\\x", "", ".", "doc-manifest.json"])
def test_a_failed_job_leaves_the_pages(spark, tmp_path, path):
    root = str(tmp_path)
    page_sink.write_pages(_rows(spark, ("a.md", "1")), root)
    pages = lambda: {p.name: p.read_text() for p in tmp_path.iterdir() if not p.name.startswith("_staging-")}  # noqa: E731  of a task that outlived its job
    before = pages()
    with pytest.raises(Exception, match="leaves the folder"):
        page_sink.write_pages(_rows(spark, ("a.md", "2"), ("b.md", "2"), (path, "3")), root)
    assert pages() == before


def test_one_page_a_path(spark, tmp_path):
    with pytest.raises(Exception, match="more than one page"):
        page_sink.write_pages(_rows(spark, ("a.md", "1"), ("./a.md", "2")), str(tmp_path))
    assert list(tmp_path.iterdir()) == []


def test_manifest_entries(spark):
    pages = spark.createDataFrame([("a.py", "f-a"), ("b.py", None), ("c.py", "f-c")], "path string, slug string")
    counts = spark.createDataFrame([("a.py", 2, 1)], "file string, entity_count long, import_count long")
    assert sorted(tuple(r) for r in documents.manifest_entries(pages, counts).collect()) == [("a.py", "files/f-a.md", 2, 1), ("c.py", "files/f-c.md", 0, 0)]
