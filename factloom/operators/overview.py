"""The pages of a whole project: index, architecture, module map, dependency map and coverage.

They list all modules and imports of a project, so that none is ever one row: a
page is its numbered lines, dealt by ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.documents import EMPTY, FILE_CATEGORIES, HEAD, IMPORT_COLUMNS, LINE, NO_DATA, fixed, lines, number, table, table_head
from factloom.operators.numbering import numbered
from factloom.scratch import Scratch

# What pages say.
UNDETERMINED, NO_NAME, README = "не определено", "unknown-project", "README.md"
DEPENDENCY_TYPES = ("internal", "stdlib", "node_builtin", "third_party", "unresolved", "unknown")
UNRESOLVED = ("unresolved", "unknown")
CORE_TYPES, ENTRY_TYPES, TEST_TYPES = ("package", "directory", "feature", "name_cluster", "unknown"), ("entrypoint",), ("fixture", "test_asset", "test_target")
MAP_COLUMNS = ("name", "type", "module_page_role", "confidence", "doc", "source_files", "test_files")
RELATION_COLUMNS = ("relation_type", "source", "target", "confidence", "reason")
DEPENDENCY_COLUMNS = ("name", "version", "manifest_type", "ecosystem", "source_file")
COVERAGE_FIELDS = ("indexed_file_count", "deep_analyzed_file_count", "shallow_indexed_file_count", "unsupported_deep_extensions", "supported_languages", "detected_supported_languages", "unresolved_import_count", "low_confidence_entity_count", "limitations")
COVERAGE_LISTS = ("unsupported_deep_extensions", "supported_languages", "detected_supported_languages", "limitations")
CONTENTS = (
    "- [Архитектура](architecture.md)", "- [Карта модулей](module-map.md)", "- [Карта зависимостей](dependency-map.md)", "- [Покрытие анализа](coverage-report.md)", "- [Индекс функций, классов и методов](functions/function-index.md)",
    "- [Индекс файлов](files/index.md)", "- [Каталог модулей](modules/)", "",
    "> Документация создана по результатам статического анализа JSON-артефактов. Она не гарантирует полноту runtime-поведения и не заменяет ручное архитектурное описание.", "",
)
NOT_FOUND_OUT = ("- Бизнес-назначение проекта.", "- Runtime-поведение.", "- Внешние API.", "- Побочные эффекты.", "- Динамические импорты.", "- Сценарии запуска, если они не представлены в JSON.", "")
README_SAID = ("- `README.md` присутствует в inventory, но render-слой не читает его напрямую.", "- `README.md` не обнаружен в inventory.")
FACTS_ONLY = "- Render-слой строит документацию только по JSON-артефактам анализа и не перечитывает исходные файлы."
NOT_PRODUCTION = "- Это тестовый/примерный артефакт, а не production-модуль."
MAYBE_MORE = "> Динамические импорты и runtime-generated dependencies могут отсутствовать."
NO_WARRANTY = (
    "", "## Что эта документация не гарантирует", "", "- Dynamic imports не гарантируются.", "- Runtime-generated dependencies не гарантируются.", "- Regex-based JS/TS extraction может быть приблизительным.",
    "- Unknown file types индексируются поверхностно.", "- Бизнес-смысл не выводится надежно без ручного описания или LLM-слоя.", "",
)


def project_name(name: Column, path: Column) -> Column:
    """A project's name: as given, else its folder's, else a fixed one."""
    folder = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(folder, F.lit("")), F.lit(NO_NAME))


def first_number(*values: Column) -> Column:
    """The first that isn't NULL, as text."""
    return F.coalesce(*[v.cast("string") for v in values], F.lit(NO_DATA))


def inline_list(items: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(F.filter(items, lambda x: x != ""), ", "), F.lit("")), F.lit(NO_DATA))


def bullets(items: Column) -> Column:
    """A list's lines as one text."""
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), F.coalesce(x, F.lit(NO_DATA)))), "\n")).otherwise(NO_DATA)


def page_lines(pages: dict[str, list[DataFrame]]) -> DataFrame:
    """(key, page, number, line): each page's lines in order. A heading stands only above rows, and what is said of an empty section only without; both are known from a row per page and section."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("page", F.lit(name)) for name, parts in pages.items() for p in parts])
    full = rows.filter(F.col("kind") == LINE).select("key", "page", "section").distinct().withColumn("_full", F.lit(True))
    other = rows.filter(F.col("kind") != LINE).join(full, ["key", "page", "section"], "left").filter(F.coalesce("_full", F.lit(False)) == (F.col("kind") == HEAD))
    whole = rows.filter(F.col("kind") == LINE).unionByName(other.drop("_full")).withColumn("later", F.col("kind") == LINE)
    return numbered(whole, "section", "later", "place", "line", by=("key", "page")).select("key", "page", "number", "line")


def _counted(projects: DataFrame, inventory: DataFrame, imports: DataFrame, **tables: DataFrame) -> DataFrame:
    """Projects with the numbers of their rows, of imports of each type (as stored in dependency_type_counts, if they are), and whether there is a README."""
    zero = F.lit(0).cast("long")
    kind = F.coalesce(F.nullif("dependency_type", F.lit("")), F.lit("unknown"))
    counts = {name: of.groupBy("project").agg(F.count("*").alias(f"_{name}")) for name, of in tables.items()}
    counts["files"] = inventory.groupBy("project").agg(F.count("*").alias("_files"), F.max(F.col("path") == README).alias("_readme"))
    counts["imports"] = imports.groupBy("project").agg(F.count("*").alias("_imports"), *[F.count_if(kind == k).alias(f"_{k}") for k in DEPENDENCY_TYPES])
    rows = reduce(lambda a, b: a.join(b, "project", "left"), counts.values(), projects)
    stored = F.col("dependency_type_counts")
    rows = rows.withColumns({f"_{k}": F.when(stored.isNotNull(), F.coalesce(F.try_element_at(stored, F.lit(k)), zero)).otherwise(F.coalesce(f"_{k}", zero)) for k in DEPENDENCY_TYPES})
    return rows.withColumns({f"_{n}": F.coalesce(f"_{n}", zero) for n in counts}).withColumn("_readme", F.coalesce("_readme", F.lit(False)))


def third_party(dependencies: DataFrame, imports: DataFrame) -> DataFrame:
    """(project, DEPENDENCY_COLUMNS): what manifests declare, or, in projects without any declaration, what imports need."""
    nothing = F.lit(None).cast("string")
    needed = imports.filter("dependency_type = 'third_party'").select("project", F.coalesce("imported", F.lit("")).alias("_i"), F.coalesce("matched_dependency", F.lit("")).alias("_m")).distinct()
    needed = needed.join(dependencies.select("project"), "project", "left_anti")
    needed = needed.select("project", F.coalesce(F.nullif("_m", F.lit("")), F.nullif("_i", F.lit(""))).alias("name"), *[nothing.alias(c) for c in DEPENDENCY_COLUMNS[1:]])
    return dependencies.select("project", *DEPENDENCY_COLUMNS).unionByName(needed)


def _module_section(link: Column) -> Column:
    """What the module map says of a module, bounded by its row."""
    said = lambda c: F.concat(F.lit(f"- `{c[0]}`: `"), F.coalesce(F.nullif(F.col(c[1]).cast("string"), F.lit("")), F.lit(NO_DATA)), F.lit("`"))
    files = [F.concat(F.lit(f"- `{c}`: "), inline_list(F.col(c))) for c in FILE_CATEGORIES]
    relation = lambda x: F.concat(F.lit("| "), F.array_join(F.array(*[F.coalesce(F.nullif(x[c].cast("string"), F.lit("")), F.lit(NO_DATA)) for c in RELATION_COLUMNS]), " | "), F.lit(" |"))
    head = "| " + " | ".join(RELATION_COLUMNS) + " |\n| " + " | ".join("---" for _ in RELATION_COLUMNS) + " |"
    relations = F.when(F.coalesce(F.size("relations"), F.lit(0)) > 0, F.concat(F.lit(head + "\n"), F.array_join(F.transform("relations", relation), "\n"))).otherwise(NO_DATA)
    texts = [
        F.concat(F.lit("## "), F.coalesce("name", F.lit(NO_DATA))), F.lit(""), said(("type", "type")), said(("module_page_role", "role")), said(("confidence", "confidence")), F.concat(F.lit("- Документ: "), link),
        F.when(F.col("role") == "test", F.lit(NOT_PRODUCTION)), F.lit(""), F.lit("### Файлы по категориям"), F.lit(""), *files,
    ]
    for heading, body in (("Related files", bullets(F.col("related_files"))), ("Relations", relations), ("Reasons", bullets(F.col("reasons"))), ("Warnings", bullets(F.col("warnings")))):
        texts += [F.lit(""), F.lit(f"### {heading}"), F.lit(""), body]
    return F.concat_ws("\n", *texts, F.lit(""))


def project_pages(projects: DataFrame, inventory: DataFrame, entities: DataFrame, imports: DataFrame, dependencies: DataFrame, modules: DataFrame, file_pages: DataFrame) -> DataFrame:
    """(project, page, number, line) of every project's five pages; a line may hold several lines of text.

    projects: project, project_name, project_path, generated_at, schema_version,
    analysis_dir, tests, fixtures, generated (what was included: text or NULL),
    file_count, source_file_count, test_file_count, config_file_count, entity_count,
    import_count (as stored, or NULL), dependency_type_counts (a map, or NULL) and
    COVERAGE_FIELDS; inventory: project, path; entities, file_pages: project;
    imports: project, line_start, matched_dependency and IMPORT_COLUMNS;
    dependencies: project and DEPENDENCY_COLUMNS; modules: project, pos (their
    order), name, type, role, confidence, slug, the arrays of FILE_CATEGORIES, reasons,
    warnings, and relations (an array of structs of RELATION_COLUMNS).
    """
    key = F.col("project")
    # a row for each project, which every page reads
    rows = Scratch(projects.sparkSession, "projects").table(_counted(projects, inventory, imports, entities=entities, modules=modules, pages=file_pages))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit(NO_DATA)) for p in parts])
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    mode = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(UNDETERMINED))
    stored = lambda said, *names: text(f"- {said}: ", first_number(*[F.col(n) for n in names]))
    index = fixed(rows, key, {0: [
        text("# Документация проекта: ", project_name(F.col("project_name"), F.col("project_path"))), "", text("Дата генерации: `", F.col("generated_at"), "`"), "", "## Режим анализа", "",
        text("- Tests included: ", mode("tests")), text("- Fixtures included: ", mode("fixtures")), text("- Generated files included: ", mode("generated")), "", "## Краткая сводка", "",
        stored("Файлов", "file_count", "_files"), stored("Source-файлов", "source_file_count"), stored("Test-файлов", "test_file_count"), stored("Config-файлов", "config_file_count"),
        stored("Найденных сущностей", "entity_count", "_entities"), stored("Импортов", "import_count", "_imports"), stored("Кандидатов модулей", "_modules"), stored("File pages", "_pages"),
        text("- `unresolved`/`unknown` imports: ", F.col("_unresolved") + F.col("_unknown")), "", "## Разделы", "", *CONTENTS,
    ]})

    named = lambda types, section: lines(modules.filter(F.col("type").isin(*types)), key, section, text("- `", F.col("name"), "` (`", F.coalesce(blank("type"), F.lit("unknown")), "`)"), number(F.col("pos")))
    nobody = lambda section: lines(rows, key, section, F.lit(NO_DATA), kind=EMPTY)
    listed = lambda said, c: text(f"- {said}: ", inline_list(F.col(c)))
    architecture = [
        fixed(rows, key, {
            0: ["# Архитектура проекта", "", "## Источник данных", "", text("- `analysis_dir`: `", F.col("analysis_dir"), "`"), text("- `schema_version`: `", blank("schema_version"), "`"), text("- `generated_at`: `", blank("generated_at"), "`"), "",
                "## Общая структура проекта", "", "### Основные директории и пакеты", ""],
            2: ["", "### Entry point candidates", ""], 4: ["", "### Test, fixture и test asset candidates", ""],
            6: ["", "## Границы анализа", "", listed("Поддержанные языки", "supported_languages"), listed("Обнаруженные поддержанные языки", "detected_supported_languages"), stored("Глубоко проанализированных файлов", "deep_analyzed_file_count"),
                stored("Поверхностно проиндексированных файлов", "shallow_indexed_file_count"), listed("`unsupported_deep_extensions`", "unsupported_deep_extensions"), "", "### Ограничения текущего анализа", "", bullets(F.col("limitations")), "",
                "## Наблюдения по данным inventory", "", F.when(F.col("_readme"), README_SAID[0]).otherwise(README_SAID[1]), FACTS_ONLY, "", "## Что не удалось определить автоматически", "", *NOT_FOUND_OUT],
        }),
        named(CORE_TYPES, 1), nobody(1), named(ENTRY_TYPES, 3), nobody(3), named(TEST_TYPES, 5), nobody(5),
    ]

    link = text("[modules/", F.col("slug"), ".md](modules/", F.col("slug"), ".md)")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    shown = dict(zip(MAP_COLUMNS, (F.col("name"), F.col("type"), F.col("role"), F.col("confidence"), link, size("source_files"), size("test_files")), strict=True))
    module_map = [
        fixed(rows, key, {0: ["# Карта модулей", "", "## Сводка", ""], 2: [""]}), *table_head(rows, key, 1, MAP_COLUMNS), table(modules, key, 1, shown, number(F.col("pos"))),
        lines(modules, key, 3, _module_section(link), number(F.col("pos"))),
    ]

    order = [F.col("source_file"), F.col("imported"), F.col("resolved_file"), number(F.col("line_start"))]
    of_import, of_dependency = {c: F.col(c) for c in IMPORT_COLUMNS}, {c: F.col(c) for c in DEPENDENCY_COLUMNS}
    dependency_map = [
        fixed(rows, key, {
            0: ["# Карта зависимостей", "", "## Сводка по `dependency_type`", "", *[text(f"- `{k}`: ", F.col(f"_{k}")) for k in DEPENDENCY_TYPES], "", "## Все импорты", ""],
            2: ["", "## Third-party dependencies", ""], 4: ["", "## Unresolved and unknown imports", ""], 6: ["", MAYBE_MORE, ""],
        }),
        *table_head(rows, key, 1, IMPORT_COLUMNS), table(imports, key, 1, of_import, *order), *table_head(rows, key, 3, DEPENDENCY_COLUMNS),
        table(third_party(dependencies, imports), key, 3, of_dependency, F.col("name"), F.col("manifest_type"), F.col("source_file")),
        *table_head(rows, key, 5, IMPORT_COLUMNS), table(imports.filter(F.col("dependency_type").isin(*UNRESOLVED)), key, 5, of_import, *order),
    ]

    value = lambda c: inline_list(F.col(c)) if c in COVERAGE_LISTS else F.col(c).cast("string")
    fields = rows.select("project", F.posexplode(F.array(*[F.struct(F.lit(c).alias("field"), value(c).alias("value")) for c in COVERAGE_FIELDS])).alias("pos", "x")).select("project", "pos", "x.*")
    coverage = [
        fixed(rows, key, {0: ["# Покрытие анализа", ""], 2: list(NO_WARRANTY)}), *table_head(rows, key, 1, ("field", "value")),
        table(fields, key, 1, {"field": F.col("field"), "value": F.col("value")}, number(F.col("pos"))),
    ]
    return page_lines({"index.md": [index], "architecture.md": architecture, "module-map.md": module_map, "dependency-map.md": dependency_map, "coverage-report.md": coverage}).withColumnRenamed("key", "project")
