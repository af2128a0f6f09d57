"""Resolution of names and specifiers to rows of other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import paths
from factloom.functions.text import node_package

# Modules that come with Node.
NODE_BUILTINS = (
    "assert", "assert/strict", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "diagnostics_channel",
    "dns", "dns/promises", "domain", "events", "fs", "fs/promises", "http", "http2", "https", "inspector", "module", "net", "os", "path", "path/posix",
    "path/win32", "perf_hooks", "process", "punycode", "querystring", "readline", "readline/promises", "repl", "stream", "stream/consumers",
    "stream/promises", "stream/web", "string_decoder", "sys", "timers", "timers/promises", "tls", "trace_events", "tty", "url", "util", "util/types",
    "v8", "vm", "wasi", "worker_threads", "zlib",
)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last in the order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def module_index(files: DataFrame) -> DataFrame:
    """(module, path) of Python files; of two files that make one module the last path wins."""
    rows = files.filter(paths.language(F.col("path")) == "python").select(paths.python_module(F.col("path")).alias("module"), "path")
    return rows.groupBy("module").agg(F.max("path").alias("path"))


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Left lookup in a table whose keys may repeat: the greatest value wins."""
    return rows.join(table.groupBy(key).agg(F.max(value).alias(value)), key, "left")


def under_prefixes(rows: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """Pairs of a row and a root that is its path or lies above it: an equi-join on exploded ancestors."""
    above = F.concat(F.array(F.lit(".")), paths.ancestors(F.col(path)), F.array(F.col(path)))
    return rows.withColumn(root, F.explode(above)).join(roots, root)


def nearest_root(rows: DataFrame, roots: DataFrame, keys: list[str], path: str = "path", root: str = "root") -> DataFrame:
    """The deepest root above each row, NULL where there is none."""
    met = under_prefixes(rows, roots.select(root).distinct(), path, root)
    best = met.groupBy(*keys).agg(F.max_by(root, F.when(F.col(root) == ".", 0).otherwise(paths.depth(F.col(root)))).alias(root))
    return rows.join(best, keys, "left")


def project_roots(files: DataFrame) -> DataFrame:
    """Directories that hold a project's marker file, and the project itself."""
    marked = files.filter(F.lower(paths.name(F.col("path"))).isin(*paths.PROJECT_MARKERS)).select(paths.parent(F.col("path")).alias("root"))
    return marked.unionByName(files.sparkSession.range(1).select(F.lit(".").alias("root"))).distinct()


def subtree_counts(files: DataFrame) -> DataFrame:
    """(directory, n) of files at any depth below."""
    return files.select(F.explode(paths.ancestors(F.col("path"))).alias("directory")).groupBy("directory").agg(F.count("*").alias("n"))


def matched_arrays(rows: DataFrame, declared: DataFrame, on: list[str], columns: list[str], name: str = "matched") -> DataFrame:
    """Left join to all matches at once, as a sorted array of structs."""
    grouped = declared.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    return rows.join(grouped, on, "left")


def first_candidate(rows: DataFrame, candidates: Column, existing: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """The first of an ordered array of candidates that exists, NULL where none does."""
    tried = rows.select(*keys, F.posexplode(candidates).alias("_at", path))
    best = tried.join(existing.select(path).distinct(), path).groupBy(*keys).agg(F.min_by(path, "_at").alias("resolved"))
    return rows.join(best, keys, "left")


def script_candidates(base: Column) -> Column:
    """A specifier's path as it stands, with the known extensions if it has none, then as a directory with an index file."""
    has = paths.extension(base) != ""
    files, indexes = ([F.concat(base, F.lit(x + e)) for e in paths.SCRIPT_EXTENSIONS] for x in ("", "/index"))
    return F.when(has, F.array(base, *indexes)).otherwise(F.array(base, *files, *indexes))


def joined_path(directory: Column, relative: Column) -> Column:
    """directory/relative with . and .. worked out; NULL if it leaves the root."""
    steps = F.filter(F.concat(F.when(directory == ".", F.array().cast("array<string>")).otherwise(F.split(directory, "/")), F.split(relative, "/")), lambda x: (x != "") & (x != "."))
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok"))
    walked = F.aggregate(
        steps, start,
        lambda a, x: F.when(x == "..", F.struct(F.slice(a["p"], F.lit(1), F.greatest(F.size(a["p"]) - 1, F.lit(0))).alias("p"), (a["ok"] & (F.size(a["p"]) > 0)).alias("ok")))
        .otherwise(F.struct(F.concat(a["p"], F.array(x)).alias("p"), a["ok"].alias("ok"))),
    )
    return F.when(walked["ok"], F.array_join(walked["p"], "/"))


def resolve_scripts(imports: DataFrame, files: DataFrame, declared: DataFrame) -> DataFrame:
    """Edges of JavaScript and TypeScript imports: internal, node_builtin, third_party or unresolved.

    imports: id, source_file, imported, ...; declared: ecosystem, normalized_name.
    """
    local = F.col("imported").rlike(r"^[./]")
    base = F.when(F.col("imported").startswith("/"), F.regexp_replace("imported", "^/+", "")).otherwise(joined_path(paths.parent(F.col("source_file")), F.col("imported")))
    found = first_candidate(imports, F.when(local & base.isNotNull(), script_candidates(base)).otherwise(F.array().cast("array<string>")), files, ["id"])
    known = declared.filter("ecosystem = 'node'").select("normalized_name").distinct()
    found = found.withColumn("_package", node_package(F.col("imported"))).join(known.withColumn("_known", F.lit(True)), F.col("_package") == F.col("normalized_name"), "left")
    kind = (
        F.when(local, "internal").when(F.regexp_replace("imported", "^node:", "").isin(*NODE_BUILTINS), "node_builtin").when(F.col("_known"), "third_party")
        .when(F.col("imported") != "", "unresolved").otherwise("unknown")
    )
    return edge_flags(found.withColumn("dependency_type", kind).withColumnRenamed("resolved", "resolved_file").drop("_package", "_known", "normalized_name"))


def edge_flags(edges: DataFrame) -> DataFrame:
    return edges.withColumns({
        "resolved": F.col("resolved_file").isNotNull() | F.col("dependency_type").isin("stdlib", "node_builtin", "third_party"),
        "is_internal": F.col("dependency_type") == "internal", "is_external": F.col("dependency_type").isin("stdlib", "node_builtin", "third_party"),
    })

