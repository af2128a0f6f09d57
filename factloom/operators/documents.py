"""Whole pages from many tables in one shuffle.

Every table gives lines: the page they belong to, the section, their place in it
and the text. Their union is dealt by page once, and a page is its lines in order.
A section's heading row stands only above rows, and what is said of an empty one
only without.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import cell

# What pages say.
NO_DATA = "нет данных"
PURPOSE = "Назначение не определено автоматически. Ниже приведена структурная информация, извлеченная из JSON-артефактов анализа."
NO_RELATED = "Связи между модулями не определены автоматически."
TEST_NOTE = "Это не production-модуль, а тестовый/примерный артефакт."
MANUAL = ("Бизнес-назначение модуля.", "Runtime-поведение.", "Внешние API.", "Побочные эффекты.", "Сценарии использования.")
FILE_CATEGORIES = ("source_files", "test_files", "config_files", "doc_files", "other_files", "related_files")
ENTITY_COLUMNS = ("name", "entity_type", "type", "file", "parent/container", "signature", "parameters", "return_annotation", "is_async", "exported", "docstring/jsdoc", "confidence")
IMPORT_COLUMNS = ("source_file", "imported", "dependency_type", "resolved_file")

#: How many key entities a module's page shows, by its role, and else.
LIMITS, LIMIT = {"detailed": 30}, 15
#: Kinds of lines: always there, only above lines that are always there, only without them.
LINE, HEAD, EMPTY = 0, 1, 2


def _parts(section: int, text: Column, *by: Column, kind: int = LINE) -> list[Column]:
    place = F.array(*[F.coalesce(b.cast("string"), F.lit("")) for b in by]) if by else F.array().cast("array<string>")
    return [F.lit(section).alias("section"), place.alias("place"), F.lit(kind).alias("kind"), text.alias("line")]


def lines(rows: DataFrame, key: Column, section: int, text: Column, *by: Column, kind: int = LINE) -> DataFrame:
    return rows.select(key.alias("key"), *_parts(section, text, *by, kind=kind))


def said(section: int, text: Column | str, when: Column | None = None, kind: int = LINE) -> Column:
    """A line, or several as one text, of a section without others of its kind; none unless ``when``."""
    one = F.struct(*_parts(section, F.lit(text) if isinstance(text, str) else text, kind=kind))
    return one if when is None else F.when(when, one)


def gathered(rows: DataFrame, key: Column, *lines: Column) -> DataFrame:
    """(key, l): all that a row says, by ``said``, as one row."""
    return rows.select(key.alias("key"), F.filter(F.array(*lines), lambda x: x.isNotNull()).alias("l"))


def text_of(*lines: Column | str) -> Column:
    """Lines as one text; a NULL one is empty."""
    return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else F.coalesce(x, F.lit("")) for x in lines])


def number(n: Column) -> Column:
    """A number as text that sorts like it; NULL last."""
    return F.coalesce(F.lpad(n.cast("string"), 12, "0"), F.lit("~"))


def fixed(rows: DataFrame, key: Column, lines: dict[int, list[Column | str]]) -> DataFrame:
    """Lines that every page has, by section."""
    said = [F.struct(F.lit(s).alias("section"), number(F.lit(i)).alias("i"), (F.lit(x) if isinstance(x, str) else x).alias("line")) for s, texts in lines.items() for i, x in enumerate(texts)]
    return rows.select(key.alias("key"), F.explode(F.array(*said)).alias("x")).select("key", "x.section", F.array("x.i").alias("place"), F.lit(LINE).alias("kind"), "x.line")


def table(rows: DataFrame, key: Column, section: int, cells: dict[str, Column], *by: Column) -> DataFrame:
    """A table's lines; its head comes with the pages, by ``table_head``."""
    shown = F.array(*[F.coalesce(F.nullif(cell(c.cast("string")), F.lit("")), F.lit(NO_DATA)) for c in cells.values()])
    return lines(rows, key, section, F.concat(F.lit("| "), F.array_join(shown, " | "), F.lit(" |")), *by)


def table_head(pages: DataFrame, key: Column, section: int, columns: tuple[str, ...], empty: str = NO_DATA) -> list[DataFrame]:
    """The head of a section's table, and what stands there without rows."""
    return [lines(pages, key, section, F.lit(_head(columns)), F.lit(""), kind=HEAD), lines(pages, key, section, F.lit(empty), F.lit(""), kind=EMPTY)]


def _head(columns: tuple[str, ...]) -> str:
    return "| " + " | ".join(columns) + " |\n| " + " | ".join("---" for _ in columns) + " |"


def table_said(section: int, columns: tuple[str, ...], empty: str = NO_DATA) -> list[Column]:
    """What ``table_head`` gives, for ``gathered``."""
    return [said(section, _head(columns), kind=HEAD), said(section, empty, kind=EMPTY)]


def assembled(parts: list[DataFrame]) -> DataFrame:
    """(key, page) of the keys that have a line in section 0. parts: lines, or what ``gathered`` gives. One page is gathered at a time."""
    parts = [p if "l" in p.columns else p.select("key", F.array(F.struct("section", "place", "kind", "line")).alias("l")) for p in parts]
    rows = reduce(DataFrame.unionByName, parts)
    whole = rows.groupBy("key").agg(F.sort_array(F.flatten(F.collect_list("l"))).alias("l"))
    full = F.array_distinct(F.transform(F.filter("l", lambda x: x["kind"] == LINE), lambda x: x["section"]))
    whole = whole.withColumn("full", full).filter(F.array_contains("full", 0))
    stays = lambda x: F.when(x["kind"] == LINE, F.lit(True)).otherwise(F.array_contains("full", x["section"]) == (x["kind"] == HEAD))
    return whole.select("key", F.array_join(F.transform(F.filter("l", stays), lambda x: F.coalesce(x["line"], F.lit(""))), "\n").alias("page"))


def file_pages(files: DataFrame, entities: DataFrame, imports: DataFrame, members: DataFrame) -> DataFrame:
    """(path, page) of every file's page.

    files: path; entities: file, name, line_start and columns named as in
    ENTITY_COLUMNS but for file; imports: source_file, line_start, imported,
    dependency_type, resolved_file; members: file, name, slug, type, role of the
    modules that list the file.
    """
    key, of_entity = F.col("path"), tuple(c for c in ENTITY_COLUMNS if c != "file")
    of_import = tuple(c for c in IMPORT_COLUMNS if c != "source_file")
    unknown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    link = F.concat(F.lit("- ["), "name", F.lit("](../modules/"), "slug", F.lit(".md) (`"), unknown("type"), F.lit("`, `"), unknown("role"), F.lit("`)"))
    heads = fixed(files, key, {0: [F.concat(F.lit("# Файл: "), key), "", "## Сущности", ""], 2: ["", "## Импорты", ""], 4: ["", "## Участвует в модулях", ""], 6: [""]})
    return assembled([
        heads, *table_head(files, key, 1, of_entity), *table_head(files, key, 3, of_import), lines(files, key, 5, F.lit(NO_DATA), kind=EMPTY),
        table(entities, F.col("file"), 1, {c: F.col(f"`{c}`") for c in of_entity}, number(F.col("line_start")), F.col("name"), F.col("entity_type")),
        table(imports, F.col("source_file"), 3, {c: F.col(c) for c in of_import}, F.col("imported"), F.col("resolved_file"), number(F.col("line_start"))),
        lines(members, F.col("file"), 5, link, F.col("name"), F.col("slug")),
    ]).withColumnRenamed("key", "path")


def _listed(files: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(files, ", "), F.lit("")), F.lit(NO_DATA))


def _overview(role: Column) -> Column:
    """What a page of the role says first, as an array of lines."""
    count = lambda said, c: F.concat(F.lit(f"- {said}: "), F.col(c).cast("string"))
    files = lambda said, c: F.concat(F.lit(f"- {said}: "), _listed(F.col(c)))
    n_files, n_entities, n_imports, main = count("Количество файлов", "file_count"), count("Количество сущностей", "entity_count"), count("Количество импортов", "import_count"), files("Основные файлы", "primary_files")
    indexes = (F.lit("- Полный индекс функций: [functions/function-index.md](../functions/function-index.md)"), F.lit("- Индекс файлов: [files/index.md](../files/index.md)"))
    said = {
        "aggregate": ("Это обзорная aggregate-страница. Она не является полным индексом всех сущностей.", n_files, n_entities, n_imports, main, *indexes),
        "entrypoint": ("Это entrypoint-страница. Она показывает структурный обзор точки входа, а не полный индекс всех функций.", files("Entry point files", "entrypoint_files"), files("Связанные файлы", "primary_files"), n_entities, n_imports),
        "test": ("Это тестовый/примерный артефакт, а не production-модуль.", files("Test files", "test_files"), files("Related production/source files", "related_files"), n_entities, n_imports),
        "detailed": (None, n_files, n_entities, n_imports, main),
    }
    other = ("Это осторожное представление структурных данных. Архитектурные выводы не делаются автоматически.", n_files, n_entities, n_imports)
    lines = lambda note, *more: F.array(*([F.lit(note), F.lit("")] if note else []), *more)
    out = None
    for name, texts in said.items():
        out = F.when(role == name, lines(*texts)) if out is None else out.when(role == name, lines(*texts))
    return out.otherwise(lines(*other))


def most_shown(role: Column, limits: dict[str, int] | None = None) -> Column:
    """How many key entities the page of a module of this role shows."""
    pairs = [F.lit(x) for pair in (limits or LIMITS).items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.coalesce(F.nullif(role, F.lit("")), F.lit("unknown"))), F.lit(LIMIT))


def module_pages(modules: DataFrame, entities: DataFrame, imports: DataFrame, related: DataFrame, file_slugs: DataFrame | None = None, limits: dict[str, int] | None = None) -> DataFrame:
    """(slug, page) of every module's page.

    modules: slug, name, type, role, the arrays of FILE_CATEGORIES, primary_files and
    entrypoint_files (as they are shown), warnings and limitations, and the counts file_count,
    entity_count and import_count; entities: slug, rank (among the module's key
    entities) and ENTITY_COLUMNS; imports: slug, line_start and IMPORT_COLUMNS;
    related: slug, source_file, resolved_file, target_modules, ambiguous; file_slugs:
    path, slug of files with a page, to which the table of key files links.
    """
    key, role = F.col("slug"), F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit("unknown"))
    most = most_shown(F.col("role"), limits)
    rows = modules.withColumns({"_role": role, "_most": most})
    role = F.col("_role")
    more = F.concat(F.lit("Показаны первые "), F.col("_most").cast("string"), F.lit(" сущностей. Полный список см. в [functions/function-index.md](../functions/function-index.md) и [files/index.md](../files/index.md)."))
    notes = F.array_sort(F.array_distinct(F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.when(role == "test", F.array(F.lit(TEST_NOTE))).otherwise(F.array().cast("array<string>")), F.coalesce("limitations", F.array().cast("array<string>")))))
    entity_heading = F.when(role == "detailed", "## Связанные сущности").otherwise("## Ключевые сущности")
    heads = {
        0: [F.concat(F.lit("# Модуль: "), "name"), "", "## Тип", "", F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit(NO_DATA)), "", "## Роль страницы", "", role, "", "## Назначение", "", PURPOSE, "", "## Навигация", ""],
        1: ["- [Индекс функций](../functions/function-index.md)", "- [Индекс файлов](../files/index.md)", "", "## Структурная сводка", ""],
        3: ["", "## Границы ответственности", "", *[F.concat(F.lit(f"- `{c}`: "), _listed(F.col(c))) for c in FILE_CATEGORIES], "", "## Ключевые файлы", ""],
        5: ["", entity_heading, ""], 7: [""], 9: ["## Зависимости", ""], 11: ["", "## Связи с другими модулями", ""], 13: ["", "## Предупреждения и ограничения", ""],
        15: ["", "## Что требует ручного уточнения", "", *[f"- {x}" for x in MANUAL], ""],
    }
    unpivoted = rows.select(key.alias("key"), F.inline(F.array(*[F.struct(F.lit(i).alias("c"), F.lit(c).alias("category"), F.col(c).alias("files")) for i, c in enumerate(FILE_CATEGORIES)])))
    unpivoted = unpivoted.select("key", "c", "category", F.posexplode("files").alias("i", "file"))
    if file_slugs is not None:
        unpivoted = unpivoted.join(file_slugs.select(F.col("path").alias("file"), F.col("slug").alias("_s")), "file", "left")
        unpivoted = unpivoted.withColumn("file", F.when(F.col("_s").isNotNull(), F.concat(F.lit("["), "file", F.lit("](../files/"), "_s", F.lit(".md)"))).otherwise(F.col("file")))
    overview = F.array_join(F.transform(_overview(role), lambda x: F.coalesce(x, F.lit(""))), "\n")
    of_related = ("source_file", "resolved_file", "target_modules", "ambiguous")
    whole = gathered(
        rows, key, *[said(i, text_of(*texts)) for i, texts in heads.items()], said(2, overview), *table_said(4, ("category", "file")), *table_said(6, ENTITY_COLUMNS), said(8, F.concat(more, F.lit("\n")), F.col("entity_count") > F.col("_most")),
        *table_said(10, IMPORT_COLUMNS), *table_said(12, of_related, NO_RELATED), said(14, NO_DATA, kind=EMPTY), said(14, F.array_join(F.transform(notes, lambda x: F.coalesce(F.concat(F.lit("- "), x), F.lit(""))), "\n"), F.size(notes) > 0),
    )
    shown = entities.join(rows.select("slug", "_most"), "slug").filter(F.col("rank") <= F.col("_most"))
    return assembled([
        whole, table(unpivoted, F.col("key"), 4, {"category": F.col("category"), "file": F.col("file")}, F.col("c"), number(F.col("i"))),
        table(shown, key, 6, {c: F.col(f"`{c}`") for c in ENTITY_COLUMNS}, number(F.col("rank"))),
        table(imports, key, 10, {c: F.col(c) for c in IMPORT_COLUMNS}, F.col("source_file"), F.col("imported"), F.col("resolved_file"), number(F.col("line_start"))),
        table(related, key, 12, {c: F.col(c) for c in of_related}, F.col("source_file"), F.col("resolved_file"), F.col("target_modules")),
    ]).withColumnRenamed("key", "slug")


def manifest_entries(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """(source_file, doc_path, entity_count, import_count) of files with a page. pages: path, slug; counts: file, entity_count, import_count."""
    zero = F.lit(0).cast("long")
    rows = pages.filter(F.coalesce("slug", F.lit("")) != "").join(counts.withColumnRenamed("file", "path"), "path", "left")
    return rows.select(F.col("path").alias("source_file"), F.concat(F.lit("files/"), "slug", F.lit(".md")).alias("doc_path"), F.coalesce("entity_count", zero).alias("entity_count"), F.coalesce("import_count", zero).alias("import_count"))
