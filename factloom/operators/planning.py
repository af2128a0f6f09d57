"""Plans: priorities, token budgets, and what fits into a context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import MAX_OUTPUT_TOKENS, budget_status, safety_margin, tokens

# Thresholds of the decision table.
LARGE_ENTITIES, LARGE_DEPENDENCIES, SMALL_ENTITIES = 20, 10, 5


def priority(role: Column, entities: Column, dependencies: Column) -> Column:
    large = (entities >= LARGE_ENTITIES) | (dependencies >= LARGE_DEPENDENCIES)
    return F.when(role == "test", "low").when(role == "detailed", F.when(large, "high").otherwise("medium")).when(role.isin("entrypoint", "aggregate") & (entities >= SMALL_ENTITIES), "medium").otherwise("low")


def explain_mode(role: Column, others: Column) -> Column:
    """others: whether any module isn't a test."""
    return F.when((role == "test") & others, "skip").when(role == "detailed", "full").otherwise("summary")


def output_tokens(mode: Column, entities: Column, dependencies: Column) -> Column:
    full = F.least(F.lit(MAX_OUTPUT_TOKENS), 1400 + entities * 16 + dependencies * 12)
    short = F.least(F.lit(MAX_OUTPUT_TOKENS), 900 + entities * 10 + dependencies * 8)
    return F.when(mode == "skip", 0).when(mode == "summary", short).otherwise(full).cast("long")


def prompt_overhead(mode: Column) -> Column:
    return F.when(mode == "full", 3200).when(mode == "summary", 2200).otherwise(1200)


def plan_modules(modules: DataFrame) -> DataFrame:
    """Adds priority, explain_mode and estimated_output_tokens to modules with role, entity_count and dependency_count."""
    others = modules.agg(F.max(F.col("role") != "test").alias("_others"))  # one row
    rows = modules.join(F.broadcast(others))
    rows = rows.withColumn("priority", priority(F.col("role"), F.col("entity_count"), F.col("dependency_count"))).withColumn("explain_mode", explain_mode(F.col("role"), F.coalesce("_others", F.lit(False))))
    return rows.withColumn("estimated_output_tokens", output_tokens(F.col("explain_mode"), F.col("entity_count"), F.col("dependency_count"))).drop("_others")


def plan_order() -> list[Column]:
    rank = lambda c, *names: F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c))
    return [rank("priority", "high", "medium", "low"), rank("explain_mode", "full", "summary", "skip"), rank("role", "detailed", "aggregate", "entrypoint", "test", "unknown"), F.col("name")]


def token_budget(rows: DataFrame, text: str, limit: int) -> DataFrame:
    """Adds estimated_tokens, tokens_with_margin and budget_status."""
    n = tokens(F.col(text))
    return rows.withColumn("estimated_tokens", n).withColumn("tokens_with_margin", n + safety_margin(n)).withColumn("budget_status", budget_status(n, limit))


def greedy_fill(items: Column, limit: int) -> Column:
    """Of an array of structs (pos, size) the positions that fit, in order; what overflows is passed over."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))
    fits = lambda a, x: a["used"] + x["size"] <= limit
    return F.aggregate(
        F.array_sort(items), start,
        lambda a, x: F.when(fits(a, x), F.struct((a["used"] + x["size"]).alias("used"), F.concat(a["kept"], F.array(x["pos"].cast("int"))).alias("kept"))).otherwise(a),
        lambda a: a["kept"],
    )


def reduce_context(documents: DataFrame, key: str, pos: str, text: str, limit: int) -> DataFrame:
    """(key, kept, dropped): positions of the documents that fit a module's budget, first come first served."""
    sized = F.struct(F.col(pos).cast("int").alias("pos"), tokens(F.col(text)).alias("size"))
    rows = documents.groupBy(key).agg(F.collect_list(sized).alias("_items")).withColumn("kept", greedy_fill(F.col("_items"), limit))
    return rows.select(key, "kept", F.array_sort(F.array_except(F.transform("_items", lambda x: x["pos"]), "kept")).alias("dropped"))


def select_modules(plan: DataFrame, *, only: list[str] | None = None, include_skip: bool = False, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Modules to work on, in plan order, and those that the plan skips; the limit counts after skipping."""
    if only is not None:
        known = {r["name"] for r in plan.filter(F.col("name").isin(only)).select("name").collect()}  # as many as were asked for
        if missing := sorted(set(only) - known):
            raise ValueError(f"no such modules: {', '.join(missing)}")
        plan = plan.filter(F.col("name").isin(only))
    skipped = plan.filter("explain_mode = 'skip'") if not include_skip else plan.limit(0)
    chosen = (plan if include_skip else plan.filter("explain_mode <> 'skip'")).orderBy(*plan_order())
    return (chosen if limit is None else chosen.limit(limit)), skipped


def cache_split(planned: DataFrame, stored: DataFrame, on: list[str], usable: Column) -> tuple[DataFrame, DataFrame]:
    """Planned rows that a stored, usable row with the same keys answers, and the rest."""
    hits = stored.filter(usable).select(*on).distinct()
    return planned.join(hits, on, "left_semi"), planned.join(hits, on, "left_anti")


def running_depth(lines: DataFrame, key: str, order: str, delta: Column) -> DataFrame:
    """Adds depth: the sum of the deltas of the lines before."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("depth", F.coalesce(F.sum(delta).over(w), F.lit(0)).cast("long"))


def carried_forward(lines: DataFrame, key: str, order: str, mark: Column, name: str = "section") -> DataFrame:
    """Adds the last mark at or before each line, NULL before the first."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.last(mark, ignorenulls=True).over(w))


def markdown_sections(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, heading, body) of second-level headings; lines before the first stand under '#', and repeated headings are one."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("_pos", "_line"))
    lines = carried_forward(lines, key, "_pos", F.when(F.col("_line").startswith("## "), F.trim(F.expr("substring(_line, 4)"))), "heading").withColumn("heading", F.coalesce("heading", F.lit("#")))
    body = lines.filter(~F.col("_line").startswith("## ")).groupBy(key, "heading").agg(F.array_sort(F.collect_list(F.struct("_pos", "_line"))).alias("_b"))
    return body.select(key, "heading", F.array_join(F.transform("_b", lambda x: x["_line"]), "\n").alias("body"))


def top_entities(entities: DataFrame, key: str, n: int = 30) -> DataFrame:
    """The first n of each group: exported, confident, classes first, then by file, line (NULL last) and name."""
    rank = lambda c, *names: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in names]), F.lower(F.col(c))), F.lit(0)), F.lit(9))
    order = [F.coalesce("exported", F.lit(False)).desc(), rank("confidence", "high", "medium", "low"), rank("entity_type", "class", "function", "method"), F.col("file"), F.coalesce("line_start", F.lit(10**9)), F.col("name")]
    return top_n(entities, [key], order, n)


def top_n(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)
