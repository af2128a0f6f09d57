"""The query over a project's pages, and its SQL twin: segments are projects, customers modules, orders imports, parts entities and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import overview
from factloom.operators.documents import FILE_CATEGORIES, NO_DATA
from factloom.plans.catalog import Tables, query

_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_TYPES = ("package", "entrypoint", "fixture", "odd", "name_cluster")
_KINDS = ("internal", "stdlib", "third_party", "unresolved", "")


def _listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _text(*texts: str) -> str:
    """Lines as an SQL text."""
    return " || chr(10) || ".join(t if t.startswith("(") else f"'{t}'" for t in texts)


def _rows(columns) -> str:
    return f"'| {' | '.join(columns)} |' || chr(10) || '| {' | '.join('---' for _ in columns)} |'"


_TABLES_SQL = f"""p as (select distinct c_mktsegment as project from customer),
m as (select c_mktsegment as project, c_custkey as k, c_name as name, ({_listed(_TYPES)})[c_custkey % 5 + 1] as type, case when c_custkey % 3 = 0 then 'test' when c_custkey % 3 = 1 then 'detailed' else '' end as role, case when c_custkey % 2 = 0 then 'high' end as confidence,
    '[modules/m' || c_custkey || '.md](modules/m' || c_custkey || '.md)' as link, lpad(c_custkey::varchar, 12, '0') as pos, case when c_custkey % 4 = 0 then 'src/' || c_nationkey || '.py, lib.py' else '{NO_DATA}' end as src, c_custkey % 4 = 0 as has_src from customer),
i as (select c_mktsegment as project, 'src/' || (o_orderkey % 50) || '.py' as src, 'x' || (o_orderkey % 40) as imported, ({_listed(_KINDS)})[o_orderkey % 5 + 1] as kind, case when o_orderkey % 5 = 0 then 'y' || o_custkey || '.py' end as resolved, o_orderkey as k from orders join customer on o_custkey = c_custkey),
d as (select ({_listed(_SEGMENTS)})[p_partkey % 3 + 1] as project, p_name as name, p_brand as version, p_type as manifest, p_partkey as k from part where p_partkey % 3 <> 2),
need as (select distinct project, imported as name from i where kind = 'third_party' and project not in (select project from d)),
e as (select ({_listed(_SEGMENTS)})[p_partkey % 4 + 1] as project, case when p_partkey < 4 then 'README.md' else p_name end as path from part),
n as (select p.project, (select count(*) from e where e.project = p.project) as files, (select count(*) from m where m.project = p.project) as modules, (select count(*) from i where i.project = p.project) as imports, exists (select 1 from e where e.project = p.project and path = 'README.md') as readme from p),
c as (select project, k, case when project = 'HOUSEHOLD' then case k when 'internal' then 7 when 'unknown' then 1 else 0 end else (select count(*) from i where i.project = p.project and case i.kind when '' then 'unknown' else i.kind end = x.k) end as n from p, (select unnest({_listed(overview.DEPENDENCY_TYPES)}) as k) x),
cell as (select project, src || '|' || imported as o, '| ' || src || ' | ' || imported || ' | ' || case kind when '' then '{NO_DATA}' else kind end || ' | ' || coalesce(resolved, '{NO_DATA}') || ' |' as line, kind, src, imported, coalesce(resolved, '') as resolved, lpad(k::varchar, 12, '0') as k from i)"""


def _count(k: str) -> str:
    return f"(select n from c where c.project = n.project and k = '{k}')"


_INDEX = [
    "('# Документация проекта: ' || case when project = 'BUILDING' then 'Named' when project = 'FURNITURE' then 'unknown-project' else lower(project) end)", "", "Дата генерации: `2026-01-01`", "", "## Режим анализа", "", "- Tests included: true",
    f"- Fixtures included: {overview.UNDETERMINED}", f"- Generated files included: {overview.UNDETERMINED}", "", "## Краткая сводка", "", "('- Файлов: ' || files)", "- Source-файлов: 12", f"- Test-файлов: {NO_DATA}", "- Config-файлов: 0", "('- Найденных сущностей: ' || files)",
    "('- Импортов: ' || case when project = 'HOUSEHOLD' then 5 else imports end)", "('- Кандидатов модулей: ' || modules)", "('- File pages: ' || files)", f"('- `unresolved`/`unknown` imports: ' || ({_count('unresolved')} + {_count('unknown')}))", "", "## Разделы", "", *overview.CONTENTS,
]
_ARCHITECTURE = ["# Архитектура проекта", "", "## Источник данных", "", "- `analysis_dir`: `out`", f"- `schema_version`: `{NO_DATA}`", "- `generated_at`: `2026-01-01`", "", "## Общая структура проекта", "", "### Основные директории и пакеты", ""]
_BOUNDS = [
    "", "## Границы анализа", "", "- Поддержанные языки: python, js", f"- Обнаруженные поддержанные языки: {NO_DATA}", "- Глубоко проанализированных файлов: 3", f"- Поверхностно проиндексированных файлов: {NO_DATA}", "- `unsupported_deep_extensions`: .rs", "",
    "### Ограничения текущего анализа", "", "('- one' || chr(10) || '- two')", "", "## Наблюдения по данным inventory", "", f"(case when readme then '{overview.README_SAID[0]}' else '{overview.README_SAID[1]}' end)", overview.FACTS_ONLY, "", "## Что не удалось определить автоматически", "", *overview.NOT_FOUND_OUT,
]
_DEPENDENCIES = ["# Карта зависимостей", "", "## Сводка по `dependency_type`", "", *[f"('- `{k}`: ' || {_count(k)})" for k in overview.DEPENDENCY_TYPES], "", "## Все импорты", ""]
_COVERAGE = [*[f"| {k} | {v} |" for k, v in zip(overview.COVERAGE_FIELDS, (3, 3, NO_DATA, ".rs", "python, js", NO_DATA, 1, NO_DATA, "one, two"), strict=True)]]
_MODULE = [
    "('## ' || name)", "", "('- `type`: `' || type || '`')", f"('- `module_page_role`: `' || case role when '' then '{NO_DATA}' else role end || '`')", f"('- `confidence`: `' || coalesce(confidence, '{NO_DATA}') || '`')",
    f"('- Документ: ' || link || case role when 'test' then chr(10) || '{overview.NOT_PRODUCTION}' else '' end)", "", "### Файлы по категориям", "", "('- `source_files`: ' || src)", *[f"- `{c}`: {NO_DATA}" for c in FILE_CATEGORIES[1:]],
    "", "### Related files", "", NO_DATA, "", "### Relations", "", f"(case when has_src then {_rows(overview.RELATION_COLUMNS)} || chr(10) || '| tests | ' || name || ' | lib.py | low | {NO_DATA} |' else '{NO_DATA}' end)", "", "### Reasons", "", "('- by ' || name)", "", "### Warnings", "", NO_DATA, "",
]


def _named(types, page: str, section: int) -> str:
    return f"""select project, '{page}', {section}, 1, pos, '', '', '', '- `' || name || '` (`' || type || '`)' from m where type in ({", ".join(f"'{t}'" for t in types)})
union all select project, '{page}', {section}, 0, '', '', '', '', '{NO_DATA}' from p where project not in (select project from m where type in ({", ".join(f"'{t}'" for t in types)}))"""


def _imports(section: int, test: str) -> str:
    return f"""select project, 'dependency-map.md', {section}, 1, src, imported, resolved, k, line from cell where {test}
union all select project, 'dependency-map.md', {section}, 0, '', '', '', '', case when project in (select project from cell where {test}) then {_rows(overview.IMPORT_COLUMNS)} else '{NO_DATA}' end from p"""


def _fixed(page: str, section: int, texts, of: str = "p") -> str:
    """Lines that every page has: one row for each."""
    return "\nunion all ".join(f"select project, '{page}', {section}, 1, '{i:012d}', '', '', '', {t if t.startswith('(') else repr(t)} from {of}" for i, t in enumerate(texts))


_LINES_SQL = "\nunion all ".join([
    _fixed("index.md", 0, _INDEX, "n"), _fixed("architecture.md", 0, _ARCHITECTURE), _named(overview.CORE_TYPES, "architecture.md", 1), _fixed("architecture.md", 2, ["", "### Entry point candidates", ""]), _named(overview.ENTRY_TYPES, "architecture.md", 3),
    _fixed("architecture.md", 4, ["", "### Test, fixture и test asset candidates", ""]), _named(overview.TEST_TYPES, "architecture.md", 5), _fixed("architecture.md", 6, _BOUNDS, "n"),
    _fixed("module-map.md", 0, ["# Карта модулей", "", "## Сводка", ""]), f"select project, 'module-map.md', 1, 0, '', '', '', '', {_rows(overview.MAP_COLUMNS)} from p",
    f"select project, 'module-map.md', 1, 1, pos, '', '', '', '| ' || name || ' | ' || type || ' | ' || case role when '' then '{NO_DATA}' else role end || ' | ' || coalesce(confidence, '{NO_DATA}') || ' | ' || link || ' | ' || case when has_src then 2 else 0 end || ' | 0 |' from m",
    _fixed("module-map.md", 2, [""]), f"select project, 'module-map.md', 3, 1, pos, '', '', '', {_text(*_MODULE)} from m",
    _fixed("dependency-map.md", 0, _DEPENDENCIES, "n"), _imports(1, "true"), _fixed("dependency-map.md", 2, ["", "## Third-party dependencies", ""]),
    f"""select project, 'dependency-map.md', 3, 1, name, manifest, 'package.json', '', '| ' || name || ' | ' || version || ' | ' || manifest || ' | npm | package.json |' from d
union all select project, 'dependency-map.md', 3, 1, name, '', '', '', '| ' || name || ' | {" | ".join([NO_DATA] * 4)} |' from need
union all select project, 'dependency-map.md', 3, 0, '', '', '', '', case when project in (select project from d union all select project from need) then {_rows(overview.DEPENDENCY_COLUMNS)} else '{NO_DATA}' end from p""",
    _fixed("dependency-map.md", 4, ["", "## Unresolved and unknown imports", ""]), _imports(5, "kind = 'unresolved'"), _fixed("dependency-map.md", 6, ["", overview.MAYBE_MORE, ""]),
    _fixed("coverage-report.md", 0, ["# Покрытие анализа", "", f"({_rows(('field', 'value'))})"]), _fixed("coverage-report.md", 1, _COVERAGE), _fixed("coverage-report.md", 2, overview.NO_WARRANTY),
])


@query(f"""with {_TABLES_SQL}, l(project, page, s, later, a, b, c, k, line) as ({_LINES_SQL})
select project, page, row_number() over (partition by project, page order by s, later, a, b, c, k, line) as number, line from l""")
def project_pages(t):
    return overview.project_pages(*_inputs(t))


def _inputs(t: Tables) -> tuple[DataFrame, ...]:
    k, o, p, seg = F.col("c_custkey"), F.col("o_orderkey"), F.col("p_partkey"), F.col("c_mktsegment")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    said, nothing, project = lambda *v: F.array(*[F.lit(x) for x in v]), F.lit(None).cast("string"), F.col("project")
    projects = t.customer.select(seg.alias("project")).distinct()
    number = lambda n: F.lit(n).cast("int")
    projects = projects.select(
        "project", F.when(project == "BUILDING", "Named").otherwise("").alias("project_name"), F.when(project == "FURNITURE", "/").otherwise(text("/srv/", F.lower("project"), "/")).alias("project_path"), F.lit("2026-01-01").alias("generated_at"), F.lit("").alias("schema_version"),
        F.lit("out").alias("analysis_dir"), F.lit("true").alias("tests"), nothing.alias("fixtures"), nothing.alias("generated"), number(None).alias("file_count"), number(12).alias("source_file_count"), number(None).alias("test_file_count"), number(0).alias("config_file_count"),
        number(None).alias("entity_count"), F.when(project == "HOUSEHOLD", 5).alias("import_count"), F.when(project == "HOUSEHOLD", F.create_map(F.lit("internal"), F.lit(7).cast("long"), F.lit("unknown"), F.lit(1).cast("long"))).alias("dependency_type_counts"),
        number(3).alias("indexed_file_count"), number(3).alias("deep_analyzed_file_count"), number(None).alias("shallow_indexed_file_count"), said(".rs").alias("unsupported_deep_extensions"), said("python", "", "js").alias("supported_languages"),
        F.array().cast("array<string>").alias("detected_supported_languages"), number(1).alias("unresolved_import_count"), number(None).alias("low_confidence_entity_count"), said("one", "two").alias("limitations"),
    )
    files = t.part.select(pick(_SEGMENTS, p % 4).alias("project"), F.when(p < 4, "README.md").otherwise(F.col("p_name")).alias("path"))
    imports = t.orders.join(t.customer, F.col("o_custkey") == k).select(
        seg.alias("project"), text("src/", o % 50, ".py").alias("source_file"), text("x", o % 40).alias("imported"), pick(_KINDS, o % 5).alias("dependency_type"), F.when(o % 5 == 0, text("y", F.col("o_custkey"), ".py")).alias("resolved_file"), o.alias("line_start"), nothing.alias("matched_dependency"),
    )
    dependencies = t.part.filter(p % 3 != 2).select(pick(_SEGMENTS, p % 3).alias("project"), F.col("p_name").alias("name"), F.col("p_brand").alias("version"), F.col("p_type").alias("manifest_type"), F.lit("npm").alias("ecosystem"), F.lit("package.json").alias("source_file"))
    owns = k % 4 == 0
    relation = F.struct(F.lit("tests").alias("relation_type"), F.col("c_name").alias("source"), F.lit("lib.py").alias("target"), F.lit("low").alias("confidence"), nothing.alias("reason"))
    modules = t.customer.select(
        seg.alias("project"), k.alias("pos"), F.col("c_name").alias("name"), pick(_TYPES, k % 5).alias("type"), pick(("test", "detailed", ""), k % 3).alias("role"), F.when(k % 2 == 0, "high").alias("confidence"), text("m", k).alias("slug"),
        F.when(owns, F.array(text("src/", F.col("c_nationkey"), ".py"), F.lit("lib.py"))).alias("source_files"), *[F.array().cast("array<string>").alias(c) for c in FILE_CATEGORIES[1:]], F.array(text("by ", F.col("c_name"))).alias("reasons"), F.lit(None).cast("array<string>").alias("warnings"),
        F.when(owns, F.array(relation)).alias("relations"),
    )
    return projects, files, files.select("project"), imports, dependencies, modules, files.select("project")
