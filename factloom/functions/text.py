"""Column expressions on texts: slugs, hashes, token estimates, cells of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of the planner.
MAX_INPUT_TOKENS, MAX_OUTPUT_TOKENS, NEAR_LIMIT_PERCENT = 24_000, 4_000, 80
TRUNCATION_MARK = "\n\n[truncated]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slug(text: Column, cap: int = 80, default: str = "item") -> Column:
    """ASCII slug; an empty one becomes the default."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, cap), "-+$", "")
    return F.when(s == "", default).otherwise(s)


def unicode_slug(text: Column, cap: int = 80, default: str = "item") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, cap), "-+$", "")
    return F.when(s == "", default).otherwise(s)


def short_hash(text: Column, n: int = 8) -> Column:
    return F.substring(F.sha1(text), 1, n)


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def cache_key(**fields: Column) -> Column:
    """Hash of the fields' JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the characters, rounded up."""
    return tokens_of_chars(F.length(text))


def tokens_of_chars(n: Column) -> Column:
    return F.floor((n + 3) / 4).cast("long")


def safety_margin(n: Column) -> Column:
    return F.greatest(F.lit(512), F.floor((n * 35 + 99) / 100)).cast("long")


def budget_status(n: Column, limit: int = MAX_INPUT_TOKENS) -> Column:
    return F.when(n > limit, "over_limit").when(n >= limit * NEAR_LIMIT_PERCENT // 100, "near_limit").otherwise("ok")


def truncated(text: Column, limit: int, mark: str = TRUNCATION_MARK) -> Column:
    """At most ``limit`` characters, cut after the last whole line, with a mark."""
    head = F.substring(text, 1, limit)
    cut = F.regexp_replace(F.when(head.contains("\n"), F.regexp_replace(head, r"\n[^\n]*\z", "")).otherwise(head), r"\s+\z", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit(mark)))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def plain(text: Column) -> Column:
    """Without Markdown's marks."""
    return squeezed(F.translate(text, "#*_`>|[]()!-~", " " * 13))


def cell(text: Column, cap: int = 320) -> Column:
    """A Markdown table's cell: one line, pipes escaped, long values cut."""
    one = F.replace(F.replace(F.trim(text), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
    return F.when(F.length(one) > cap, F.concat(F.substring(one, 1, cap - 1), F.lit("…"))).otherwise(one)


def brace_delta(line: Column) -> Column:
    clean = F.regexp_replace(line, "//.*$", "")
    return (F.length(F.replace(clean, F.lit("}"), F.lit(""))) - F.length(F.replace(clean, F.lit("{"), F.lit("")))).cast("int")


def python_distribution(spec: Column) -> Column:
    return F.translate(F.lower(F.get(F.split(spec, r"\["), F.lit(0))), "-.", "__")


def node_package(specifier: Column) -> Column:
    s = F.regexp_replace(specifier, "^node:", "")
    return F.regexp_extract(s, r"^(@[^/]+/[^/]+|[^/]+)", 1)


def _spec_parts(spec: Column) -> tuple[Column, Column, Column]:
    """Name, extras in brackets (empty if there are none), and what follows both."""
    s = F.trim(spec)
    name = F.regexp_extract(s, "^[A-Za-z0-9._-]*", 0)
    after = F.substr(s, F.length(name) + 1)
    extras = F.when(after.startswith("[") & (F.locate("]", after) > 2), F.left(after, F.locate("]", after))).otherwise("")
    return name, extras, F.substr(after, F.length(extras) + 1)


def spec_name(spec: Column) -> Column:
    """The name of a dependency spec, extras included; empty if it begins with no name."""
    name, extras, _ = _spec_parts(spec)
    return F.when(name == "", "").otherwise(F.concat(name, extras))


def spec_version(spec: Column) -> Column:
    """What follows the name; NULL if nothing does."""
    name, _, rest = _spec_parts(spec)
    return F.when(name != "", F.nullif(F.trim(rest), F.lit("")))


def redacted(text: Column, *secrets: Column, mask: str = "[REDACTED]") -> Column:
    out = text
    for s in secrets:
        out = F.when(F.coalesce(F.length(s), F.lit(0)) > 0, F.replace(out, s, F.lit(mask))).otherwise(out)
    return out


def unfenced(text: Column) -> Column:
    """Without a code fence around the whole text."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*\n", ""), r"\n```\s*$", "")


def embedded_json(text: Column) -> Column:
    """From the first opening to the last closing brace; NULL where there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def missing_sections(headings: Column, required: tuple[str, ...]) -> Column:
    return F.array_except(F.array(*[F.lit(x) for x in required]), headings)


def utc_time(text: Column) -> Column:
    return F.try_to_timestamp(text)


def run_slug(time: Column) -> Column:
    return F.date_format(time, "yyyyMMdd'T'HHmmss'Z'")


def signed(n: Column) -> Column:
    return F.when(n > 0, F.concat(F.lit("+"), n.cast("string"))).otherwise(n.cast("string"))


def percent(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("%.1f%%", x * 100))


def verdict(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("pass", "warning", "fail"), low)


def verdict_direction(before: Column, after: Column) -> Column:
    rank = lambda v: F.when(v == "fail", 0).when(v == "warning", 1).when(v == "pass", 2)
    a, b = rank(before), rank(after)
    return F.when(a.isNull() | b.isNull(), "unknown").when(b > a, "improved").when(b < a, "worsened").otherwise("unchanged")


def provider_status(message: Column) -> Column:
    """A status for an error's text, the first rule that fits."""
    low = F.lower(message)
    has = lambda *words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w))
    return (
        F.when(has("timeout", "timed out"), "timeout").when(has("schema"), "schema_rejected").when(has("unauthorized", "auth", "401", "403"), "auth_error")
        .when(has("rate limit", "429"), "rate_limited").otherwise("api_error")
    )


def severity(status: Column) -> Column:
    """bad, warn, good or neutral for a status or verdict."""
    low = F.lower(F.coalesce(status, F.lit("")))
    has = lambda *words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w))
    return F.when(low.isin("", "no_data", "unknown", "skipped"), "neutral").when(has("fail", "error"), "bad").when(has("warn", "partial", "missing"), "warn").when(has("ok", "pass", "success", "generated", "verified"), "good").otherwise("neutral")


def int_or_zero(value: Column) -> Column:
    return F.coalesce(value.try_cast("long"), F.lit(0).cast("long"))


def truthy(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("true", "1", "yes", "on")


def module_slug(text: Column) -> Column:
    """Letters, digits and hyphens; slashes, blanks, dots and underscores become hyphens, anything else goes."""
    dashed = F.translate(F.lower(F.trim(text)), "\\/ ._", "-----")
    kept = F.regexp_replace(F.regexp_replace(dashed, r"[^\p{L}\p{N}-]", ""), "^-+|-+$", "")
    return F.when(kept == "", "unknown").otherwise(kept)


def identity_json(name: Column, kind: Column, **lists: Column) -> Column:
    """A module's identity as JSON with sorted keys, sorted lists and blanks after commas and colons."""
    quoted = lambda s: F.substring(F.to_json(F.array(s)), F.lit(2), F.length(F.to_json(F.array(s))) - 2)
    parts = {"name": quoted(name), "type": quoted(kind), **{k: F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(v), quoted), ", "), F.lit("]")) for k, v in lists.items()}}
    return F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), parts[k]) for k in sorted(parts)]), F.lit("}"))


def preview(text: Column, limit: int = 160) -> Column:
    """The first characters in one line."""
    return F.substring(squeezed(F.coalesce(text, F.lit(""))), 1, limit)


def replaced(text: Column, pairs: dict[str, str]) -> Column:
    """All pairs, one after another."""
    for old, new in pairs.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def closed_fence(text: Column) -> Column:
    """The text, with the code fence that is open at its end closed.

    A fence is three or more backticks or tildes after at most three blanks; it
    is closed by as many of the same mark, or more, on a line of their own.
    """
    state = F.struct(F.lit("").alias("mark"), F.lit(0).alias("n"))

    def step(a: Column, line: Column) -> Column:
        run = F.regexp_extract(line, "^ {0,3}(`{3,}|~{3,})", 1)
        rest = F.regexp_extract(line, "^ {0,3}(?:`{3,}|~{3,})(.*)$", 1)
        opens = (a["mark"] == "") & (run != "")
        closes = (a["mark"] != "") & (F.left(run, F.lit(1)) == a["mark"]) & (F.length(run) >= a["n"]) & (F.trim(rest) == "")
        return F.when(opens, F.struct(F.left(run, F.lit(1)).alias("mark"), F.length(run).alias("n"))).when(closes, F.struct(F.lit("").alias("mark"), F.lit(0).alias("n"))).otherwise(a)

    left = F.aggregate(F.split(text, r"\r\n|\r|\n", -1), state, step)
    end = F.concat(F.when(text.rlike(r"[\r\n]\z"), "").otherwise("\n"), F.repeat(left["mark"], left["n"]))
    return F.when(left["mark"] == "", text).otherwise(F.concat(text, end))


def payload_errors(fields: dict[str, Column], required: tuple[str, ...], said: Column) -> Column:
    """What a report lacks: lists that are absent, and a verdict."""
    missing = [F.when(fields[f].isNull(), F.lit(f"Missing expected field: {f}.")) for f in required]
    return F.array_compact(F.array(*missing, F.when(verdict(said).isNull(), F.lit("Missing or invalid verdict."))))
