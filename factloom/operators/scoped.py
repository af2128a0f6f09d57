"""Imports of Python files below nested project roots.

A root gives the files below it names of their own, so that one module name may
mean different files. Names and roots are one index, keyed by both; an import
meets it through the roots above its file, exploded, in one equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import paths
from factloom.functions.text import python_distribution
from factloom.operators.resolve import edge_flags, under_prefixes
from factloom.scratch import Scratch


def _depth(root: Column) -> Column:
    return F.when(root == ".", 0).otherwise(paths.depth(root))


def scoped_modules(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, module, path) of Python files below each root, ``.`` being the whole project; of two files that make one name the last path wins."""
    python = files.filter(paths.language(F.col("path")) == "python").select("path").distinct()
    below = under_prefixes(python, roots.select("root").distinct())
    relative = F.when(F.col("root") == ".", F.col("path")).otherwise(F.expr("substring(path, length(root) + 2)"))
    named = below.select("root", paths.python_module(relative).alias("module"), "path").filter("module != ''")
    return named.groupBy("root", "module").agg(F.max("path").alias("path"))


def above(rows: DataFrame, roots: DataFrame, file: str = "source_file") -> DataFrame:
    """The rows with each root that their file lies below, and how deep it is."""
    return under_prefixes(rows, roots.select("root").distinct(), file).withColumn("_depth", _depth(F.col("root")))


def resolve_names(names: DataFrame, roots: DataFrame, index: DataFrame) -> DataFrame:
    """(key, name, file) of names that are modules: of the whole project, else of the deepest root above the file that has the name.

    names: key, source_file, name; index: scoped_modules.
    """
    met = above(names.filter("name != ''"), roots).join(index.withColumnRenamed("module", "name"), ["root", "name"])
    first = F.when(F.col("root") == ".", F.lit(1 << 30)).otherwise(F.col("_depth"))
    return met.groupBy("key", "name").agg(F.max_by("path", first).alias("file"))


def local_names(names: DataFrame, roots: DataFrame, index: DataFrame) -> DataFrame:
    """The keys and names whose first part begins a module of the whole project or of a root above the file."""
    begins = index.select("root", F.get(F.split("module", r"\."), F.lit(0)).alias("top")).distinct()
    tops = names.withColumn("top", F.get(F.split(F.regexp_replace("name", r"^\.+", ""), r"\."), F.lit(0)))
    return above(tops, roots).join(begins, ["root", "top"], "left_semi").select("key", "name").distinct()


def resolve_python(imports: DataFrame, files: DataFrame, roots: DataFrame, declared: DataFrame, stdlib: list[str]) -> DataFrame:
    """Edges of Python imports. Of ``from base import names`` the names that are modules make edges; only if none is, base does.

    imports: id, source_file, import_kind, imported, module, level, names,
    line_start, language; declared: ecosystem, normalized_name. An edge is internal if
    its name is a module, if it is relative, or if it begins like a module that the
    file can see.
    """
    roots = roots.select("root").unionByName(files.sparkSession.range(1).select(F.lit(".").alias("root"))).distinct()
    scratch = Scratch(files.sparkSession, "scoped")
    roots = scratch.table(roots)
    index = scratch.table(scoped_modules(files, roots))
    own = paths.python_module(F.col("source_file"))
    package = F.when(paths.name(F.col("source_file")) == "__init__.py", own).otherwise(F.regexp_replace(own, r"(^|\.)[^.]+$", ""))
    relative = F.coalesce("level", F.lit(0)) > 0
    base = F.when(F.col("import_kind") != "from", F.col("imported")).when(relative, paths.relative_base(package, F.col("level"), F.col("module"))).otherwise(F.coalesce("module", F.lit("")))
    rows = imports.withColumn("_base", base)
    of_base = rows.select(F.col("id").alias("key"), "source_file", F.col("_base").alias("name"))
    parts = rows.filter("import_kind = 'from' and _base != ''").select(F.col("id").alias("key"), "source_file", F.explode("names").alias("_n"), "_base")
    parts = parts.select("key", "source_file", F.concat_ws(".", "_base", "_n").alias("name"))
    known = scratch.table(resolve_names(of_base.unionByName(parts).distinct(), roots, index))
    hits = known.join(parts.select("key", "name").distinct(), ["key", "name"], "left_semi").groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.col("name").alias("imported"), "file"))).alias("_hits"))
    rows = rows.join(hits, F.col("id") == F.col("key"), "left").drop("key")
    rows = rows.join(known.select(F.col("key").alias("id"), F.col("name").alias("_base"), F.col("file").alias("_file")), ["id", "_base"], "left")
    label = F.coalesce(F.nullif("_base", F.lit("")), F.nullif("imported", F.lit("")), F.repeat(F.lit("."), F.coalesce("level", F.lit(0))))
    rows = rows.withColumn("_e", F.explode(F.coalesce("_hits", F.array(F.struct(label.alias("imported"), F.col("_file").alias("file"))))))
    wanted = rows.filter("_e.file is null").select(F.col("id").alias("key"), "source_file", F.col("_e.imported").alias("name")).distinct()
    local = local_names(wanted, roots, index).select(F.col("key").alias("id"), F.lit(True).alias("_local"))
    top = F.get(F.split(F.regexp_replace("_e.imported", r"^\.+", ""), r"\."), F.lit(0))
    told = declared.filter("ecosystem = 'python'").select(F.col("normalized_name").alias("_known")).distinct()
    rows = rows.join(local.distinct(), "id", "left").join(told, python_distribution(top) == F.col("_known"), "left")
    kind = (
        F.when(F.col("_e.file").isNotNull() | relative | F.coalesce("_local", F.lit(False)), "internal").when(top.isin(*stdlib), "stdlib").when(F.col("_known").isNotNull(), "third_party")
        .when(F.col("_e.imported") != "", "unresolved").otherwise("unknown")
    )
    return edge_flags(rows.select("id", "source_file", F.col("_e.imported").alias("imported"), "line_start", "import_kind", "language", F.col("_e.file").alias("resolved_file"), kind.alias("dependency_type")))
