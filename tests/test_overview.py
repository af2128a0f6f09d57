"""The five pages of a project as they must read."""

from factloom.operators import overview

PROJECT = (
    "project string, project_name string, project_path string, generated_at string, schema_version string, analysis_dir string, tests string, fixtures string, generated string, file_count int, source_file_count int, "
    "test_file_count int, config_file_count int, entity_count int, import_count int, dependency_type_counts map<string,bigint>, indexed_file_count int, deep_analyzed_file_count int, shallow_indexed_file_count int, "
    "unsupported_deep_extensions array<string>, supported_languages array<string>, detected_supported_languages array<string>, unresolved_import_count int, low_confidence_entity_count int, limitations array<string>"
)
MODULE = (
    "project string, pos int, name string, type string, role string, confidence string, slug string, source_files array<string>, test_files array<string>, config_files array<string>, doc_files array<string>, other_files array<string>, "
    "related_files array<string>, reasons array<string>, warnings array<string>, relations array<struct<relation_type:string,source:string,target:string,confidence:string,reason:string>>"
)
IMPORT = "project string, source_file string, imported string, dependency_type string, resolved_file string, line_start int, matched_dependency string"


def _pages(spark):
    projects = [
        ("p", None, "/srv/shop/", "2026-01-01", "1", "out", "true", None, "false", None, 3, None, 0, 9, None, None, 5, 2, None, [".rs"], ["python", ""], [], 1, None, ["one", "two"]),
        ("bare", "", "/", "t", "", "o", None, None, None, *[None] * 6, {"internal": 4, "unknown": 2}, *[None] * 9),
    ]
    modules = [
        ("p", 2, "core", "package", "detailed", "high", "core", ["a.py", "b.py"], None, [], [], [], ["t.py"], ["r"], [], [("tests", "t.py", "a.py", "low", None)]),
        ("p", 1, "tests", "fixture", "test", None, "tests", None, ["t.py"], [], [], [], [], None, ["w1", "w2"], None),
        ("p", 10, "main", "entrypoint", "entrypoint", "high", "main", *[None] * 9),
    ]
    imports = [("p", "b.py", "os", "stdlib", None, 1, None), ("p", "a.py", "x|y", "unresolved", None, 2, None), ("p", "a.py", "requests", "third_party", None, 1, "Requests"), ("p", "b.py", "requests", "third_party", None, 5, "Requests"), ("p", "a.py", "b", "internal", "b.py", 3, None)]
    inventory = spark.createDataFrame([("p", "README.md"), ("p", "a.py")], "project string, path string")
    dependencies = spark.createDataFrame([], "project string, name string, version string, manifest_type string, ecosystem string, source_file string")
    entities = spark.createDataFrame([("p",)] * 4, "project string")
    rows = overview.project_pages(spark.createDataFrame(projects, PROJECT), inventory, entities, spark.createDataFrame(imports, IMPORT), dependencies, spark.createDataFrame(modules, MODULE), entities.limit(2)).collect()
    pages = {}
    for r in sorted(rows, key=lambda r: (r["project"], r["page"], r["number"])):
        pages.setdefault((r["project"], r["page"]), []).append(r["line"])
    assert all(sorted(r["number"] for r in rows if (r["project"], r["page"]) == k) == list(range(1, len(v) + 1)) for k, v in pages.items())
    return {k: "\n".join(v).split("\n") for k, v in pages.items()}


def test_project_pages(spark):
    pages = _pages(spark)
    assert len(pages) == 10
    index = pages["p", "index.md"]
    assert index[0] == "# Документация проекта: shop" and index[2] == "Дата генерации: `2026-01-01`"
    assert index[6:9] == ["- Tests included: true", "- Fixtures included: не определено", "- Generated files included: false"]
    assert index[12:21] == ["- Файлов: 2", "- Source-файлов: 3", "- Test-файлов: нет данных", "- Config-файлов: 0", "- Найденных сущностей: 9", "- Импортов: 5", "- Кандидатов модулей: 3", "- File pages: 2", "- `unresolved`/`unknown` imports: 1"]
    bare = pages["bare", "index.md"]
    assert bare[0] == "# Документация проекта: unknown-project" and bare[12] == "- Файлов: 0" and bare[20] == "- `unresolved`/`unknown` imports: 2"

    architecture = pages["p", "architecture.md"]
    assert architecture[10:20] == ["### Основные директории и пакеты", "", "- `core` (`package`)", "", "### Entry point candidates", "", "- `main` (`entrypoint`)", "", "### Test, fixture и test asset candidates", ""]
    assert architecture[20:26] == ["- `tests` (`fixture`)", "", "## Границы анализа", "", "- Поддержанные языки: python", "- Обнаруженные поддержанные языки: нет данных"]
    assert "- one" in architecture and overview.README_SAID[0] in architecture and architecture[-1] == ""
    bare = pages["bare", "architecture.md"]
    assert bare[12] == bare[16] == bare[20] == "нет данных" and overview.README_SAID[1] in bare and "- `schema_version`: `нет данных`" in bare

    dependencies = pages["p", "dependency-map.md"]
    head = ["| source_file | imported | dependency_type | resolved_file |", "| --- | --- | --- | --- |"]
    assert dependencies[4:10] == ["- `internal`: 1", "- `stdlib`: 1", "- `node_builtin`: 0", "- `third_party`: 2", "- `unresolved`: 1", "- `unknown`: 0"]
    assert dependencies[13:20] == [*head, "| a.py | b | internal | b.py |", "| a.py | requests | third_party | нет данных |", "| a.py | x\\|y | unresolved | нет данных |", "| b.py | os | stdlib | нет данных |", "| b.py | requests | third_party | нет данных |"]
    assert dependencies[21:27] == ["## Third-party dependencies", "", "| name | version | manifest_type | ecosystem | source_file |", "| --- | --- | --- | --- | --- |", "| Requests | нет данных | нет данных | нет данных | нет данных |", ""]
    assert dependencies[27:] == ["## Unresolved and unknown imports", "", *head, "| a.py | x\\|y | unresolved | нет данных |", "", overview.MAYBE_MORE, ""]
    bare = pages["bare", "dependency-map.md"]
    assert bare[4] == "- `internal`: 4" and bare[13] == bare[17] == bare[21] == "нет данных"

    modules = pages["p", "module-map.md"]
    assert modules[4:9] == [
        "| name | type | module_page_role | confidence | doc | source_files | test_files |", "| --- | --- | --- | --- | --- | --- | --- |", "| tests | fixture | test | нет данных | [modules/tests.md](modules/tests.md) | 0 | 1 |",
        "| core | package | detailed | high | [modules/core.md](modules/core.md) | 2 | 0 |", "| main | entrypoint | entrypoint | high | [modules/main.md](modules/main.md) | 0 | 0 |",
    ]
    assert modules[9:19] == ["", "## tests", "", "- `type`: `fixture`", "- `module_page_role`: `test`", "- `confidence`: `нет данных`", "- Документ: [modules/tests.md](modules/tests.md)", overview.NOT_PRODUCTION, "", "### Файлы по категориям"]
    core = modules[modules.index("## core") :]
    assert core[9:16] == ["- `source_files`: a.py, b.py", "- `test_files`: нет данных", "- `config_files`: нет данных", "- `doc_files`: нет данных", "- `other_files`: нет данных", "- `related_files`: t.py", ""]
    assert core[16:32] == ["### Related files", "", "- t.py", "", "### Relations", "", "| relation_type | source | target | confidence | reason |", "| --- | --- | --- | --- | --- |", "| tests | t.py | a.py | low | нет данных |", "", "### Reasons", "", "- r", "", "### Warnings", ""]
    assert pages["bare", "module-map.md"] == ["# Карта модулей", "", "## Сводка", "", "нет данных", ""]

    coverage = pages["p", "coverage-report.md"]
    assert coverage[:8] == ["# Покрытие анализа", "", "| field | value |", "| --- | --- |", "| indexed_file_count | 5 |", "| deep_analyzed_file_count | 2 |", "| shallow_indexed_file_count | нет данных |", "| unsupported_deep_extensions | .rs |"]
    assert coverage[12] == "| limitations | one, two |" and coverage[13:] == list(overview.NO_WARRANTY)
