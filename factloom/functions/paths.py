"""Column expressions on project-relative paths: parts, kinds and roles of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, prefixes and extensions that decide what a path is.
IGNORED_DIRECTORIES = (
    ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", "node_modules", ".git", "dist",
    "build", "out", "coverage", "htmlcov", ".next", ".turbo", "__pycache__", ".venv", "venv",
)
IGNORED_SUFFIXES = (".egg-info",)
GENERATED_NAMES = (
    "analysis-summary.json", "artifact-manifest.json", "coverage-report.json", "dependency-graph.json", "function-index.json", "inventory.json",
    "module-candidates.json",
)
#: The folder that an analysis writes its facts to, and the folder of its trial runs, unless a caller names others.
OUTPUT_PREFIX, TRIAL_PREFIX = ".factloom-analysis", "factloom-smoke"
FIXTURE_MARKERS = ("tests/fixtures/", "testdata/", "fixtures/", "samples/", "sample_project/")
SOURCE_LANGUAGES = {".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".py": "python"}
OTHER_LANGUAGES = {
    ".json": "json", ".toml": "toml", ".yaml": "yaml", ".yml": "yaml", ".ini": "ini", ".cfg": "config", ".conf": "config", ".md": "markdown",
    ".rst": "rst", ".txt": "text", ".html": "html", ".css": "css",
}
DOC_EXTENSIONS = (".md", ".rst", ".txt")
ASSET_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".bmp", ".webp", ".woff", ".woff2", ".ttf", ".eot", ".pdf", ".mp3", ".mp4", ".mov", ".avi",
    ".bin", ".dat", ".zip",
)
CONFIG_EXTENSIONS = (".json", ".toml", ".yaml", ".yml", ".ini", ".cfg", ".conf")
CONFIG_NAMES = (
    "package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "requirements.txt", "pyproject.toml", "setup.py", "setup.cfg", "tox.ini",
    "pytest.ini", "tsconfig.json", "jsconfig.json", ".eslintrc", ".prettierrc", ".npmrc", ".gitignore",
)
PROJECT_MARKERS = ("package.json", "pyproject.toml", "requirements.txt", "setup.py", "tsconfig.json", "jsconfig.json")
ENTRYPOINT_NAMES = (
    "index.js", "index.jsx", "index.ts", "index.tsx", "main.js", "main.ts", "main.py", "__main__.py", "app.py", "app.js", "app.ts", "server.js",
    "server.ts", "manage.py", "cli.py",
)
DEEP_LANGUAGES = ("python", "javascript", "typescript")
SCRIPT_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".json")
GENERIC_STEMS = ("__init__", "__main__", "index", "main", "app", "cli")


def _any(*tests: Column) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))


def name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(parts(path), F.lit(-1)), F.lit(""))


def extension(path: Column) -> Column:
    """The last suffix, lower case; names that only begin with a dot have none."""
    return F.lower(F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]+$", "")


def parent(path: Column) -> Column:
    p = parts(path)
    return F.when(F.size(p) > 1, F.array_join(F.slice(p, 1, F.size(p) - 1), "/")).otherwise(".")


def depth(path: Column) -> Column:
    return F.size(parts(path))


def normalized(path: Column) -> Column:
    """Forward slashes, lower case, one slash at the end."""
    return F.concat(F.regexp_replace(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/+$", ""), F.lit("/"))


def ancestors(path: Column) -> Column:
    """All directories above the path, the nearest last."""
    p = parts(path)
    return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def is_ignored_directory(dirname: Column, output: str = OUTPUT_PREFIX, trial: str = TRIAL_PREFIX) -> Column:
    low = F.lower(dirname)
    return _any(low.isin(*IGNORED_DIRECTORIES), *[low.startswith(p) for p in (output, trial)], *[low.endswith(s) for s in IGNORED_SUFFIXES])


def is_fixture(path: Column) -> Column:
    return _any(*[normalized(path).contains(m) for m in FIXTURE_MARKERS])


def is_generated(path: Column, output: str = OUTPUT_PREFIX, trial: str = TRIAL_PREFIX) -> Column:
    """Files of an analysis: by name, packed, or below its own folders."""
    low = F.lower(name(path))
    return _any(
        low.isin(*GENERATED_NAMES), low.startswith(output) & low.endswith(".zip"),
        F.exists(parts(path), lambda x: F.lower(x).startswith(output)), normalized(path).contains(f"{trial}/"),
    )


def is_packaging_metadata(path: Column) -> Column:
    return F.exists(parts(path), lambda x: F.lower(x).endswith(".egg-info"))


def _holds(path: Column, names: tuple[str, ...], above: bool = False) -> Column:
    p = F.transform(parts(path), F.lower)
    p = F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))) if above else p
    return F.arrays_overlap(p, F.array(*[F.lit(x) for x in names]))


def is_test(path: Column) -> Column:
    low = F.lower(name(path))
    return _any(
        _holds(path, ("tests", "__tests__", "spec")) & ~_holds(path, ("fixtures", "fixture")),
        low.startswith("test_"), F.lower(stem(path)).endswith("_test"), low.contains(".test."), low.contains(".spec."),
    )


def is_config(path: Column) -> Column:
    low = F.lower(name(path))
    in_config = _holds(path, ("config",), above=True)
    return _any(low.isin(*CONFIG_NAMES), low.startswith(".env"), low.rlike(r"\.config\.(js|cjs|mjs|ts)$"), in_config & extension(path).isin(*CONFIG_EXTENSIONS))


def is_entrypoint(path: Column) -> Column:
    low, p = F.lower(name(path)), parts(path)
    top = F.lower(F.coalesce(F.get(p, F.lit(0)), F.lit("")))
    named = low.isin(*ENTRYPOINT_NAMES) & ((F.size(p) == 1) | top.isin("src", "app", "bin", "scripts") | low.isin("__main__.py", "manage.py", "cli.py"))
    return named | (extension(path).isin(*SOURCE_LANGUAGES) & (F.size(p) >= 2) & top.isin("bin", "scripts"))


def language(path: Column) -> Column:
    ext = extension(path)
    table = F.create_map(*[F.lit(x) for kv in {**SOURCE_LANGUAGES, **OTHER_LANGUAGES}.items() for x in kv])
    return F.coalesce(table[ext], F.when(name(path).isin("Dockerfile", "Makefile"), F.lower(name(path))), F.lit("unknown"))


def file_type(path: Column) -> Column:
    ext = extension(path)
    return (
        F.when(is_test(path), "test").when(is_config(path), "config").when(ext.isin(*SOURCE_LANGUAGES), "source")
        .when(ext.isin(*DOC_EXTENSIONS) | _holds(path, ("docs",)), "doc")
        .when(ext.isin(*ASSET_EXTENSIONS) | _holds(path, ("assets", "static", "public"), above=True), "asset").otherwise("unknown")
    )


def artifact_role(path: Column) -> Column:
    return F.when(is_packaging_metadata(path), "packaging_metadata").when(is_generated(path), "generated").when(is_fixture(path), "fixture")


def supports_deep_analysis(path: Column) -> Column:
    return file_type(path).isin("source", "test") & language(path).isin(*DEEP_LANGUAGES)


def normalized_stem(path: Column) -> Column:
    """The stem without test_ in front or _test, .test, .spec behind, lower case."""
    s = F.lower(stem(path))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\.(test|spec)$", ""), "^test_", ""), "_test$", "")


def python_module(path: Column) -> Column:
    """Dotted module name; a package's file names the package."""
    return F.replace(F.regexp_replace(path, r"((^|/)__init__)?\.[^./]+$", ""), F.lit("/"), F.lit("."))


def relative_base(package: Column, level: Column, module: Column) -> Column:
    """Absolute name of a relative import: the package's first parts, then the module."""
    p = F.split(package, r"\.")
    keep = F.slice(p, F.lit(1), F.greatest(F.size(p) - (level - 1), F.lit(0)))
    return F.concat_ws(".", F.nullif(F.array_join(keep, "."), F.lit("")), F.nullif(module, F.lit("")))


def strip_doc_prefix(path: Column) -> Column:
    return F.regexp_replace(path, "^[./]+", "")


def classify(paths, column: str = "path"):
    """An inventory's columns for every row of a table of paths."""
    p = F.col(column)
    return paths.select(
        "*", extension(p).alias("extension"), file_type(p).alias("file_type"), language(p).alias("language"), is_test(p).alias("is_test"), is_config(p).alias("is_config"),
        is_entrypoint(p).alias("is_possible_entrypoint"), supports_deep_analysis(p).alias("supports_deep_analysis"), is_fixture(p).alias("is_fixture"),
        is_generated(p).alias("is_generated"), is_packaging_metadata(p).alias("is_packaging_metadata"), artifact_role(p).alias("artifact_role"),
    )


def included(*, tests: bool = True, fixtures: bool = False, generated: bool = False) -> Column:
    """Rows of an inventory that stay; packaging metadata and generated files go first, then fixtures, then tests."""
    out = F.lit(True)
    if not generated:
        out = out & ~F.col("is_packaging_metadata") & ~F.col("is_generated")
    if not fixtures:
        out = out & ~F.col("is_fixture")
    return out if tests else out & ~F.col("is_test")
