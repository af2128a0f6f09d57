"""JSON objects inside texts, by a stack automaton that reads a text once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import let

#: Every character is in one token: strings' quotes and escapes, marks, numbers, names, blanks, line breaks, control characters, runs of others.
TOKEN = r"""(?s)"|\\u[0-9A-Fa-f]{4}|\\["\\/bfnrt]|\\|[{}\[\]:,]|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|-?Infinity|[A-Za-z_]++| ++|[\t\n\r]++|[\x00-\x1f]|[^"\\{}\[\]:,0-9A-Za-z_ \x00-\x1f-]++|."""
LITERALS = ("true", "false", "null", "NaN", "Infinity", "-Infinity")


def _state(at: Column, stack: Column, want: Column, quoted: Column, start: Column, end: Column, done: Column) -> Column:
    return F.struct(at.cast("long").alias("at"), stack.cast("array<long>").alias("stack"), want.cast("string").alias("want"), quoted.alias("quoted"), start.cast("long").alias("start"), end.cast("long").alias("end"), done.alias("done"))


def _step(a: Column, token: Column) -> Column:
    """The state after a token.

    stack: where open objects begin, -1 for arrays; want: what may follow (key or
    closing, key, colon, value, value or closing, next); start, end: the object that
    begins first of those closed so far. A token that can't follow ends all open
    objects; if one has been closed inside, it is the answer.
    """
    none = F.array().cast("array<long>")
    idle, want, top = F.size(a["stack"]) == 0, a["want"], F.element_at(a["stack"], -1)
    value = want.isin("value", "value or ]")
    after = a["at"] + F.length(token)
    same = lambda **changed: _state(*[changed.get(c, after if c == "at" else a[c]) for c in ("at", "stack", "want", "quoted", "start", "end", "done")])
    opened = lambda at, w: same(stack=F.concat(a["stack"], F.array(at)), want=F.lit(w))
    below = F.slice(a["stack"], F.lit(1), F.size(a["stack"]) - 1)
    ended = F.lit("next")
    failed = F.when(a["start"].isNotNull(), same(done=F.lit(True))).otherwise(
        same(stack=F.when(token == "{", F.array(a["at"])).otherwise(none), want=F.lit("key or }"), quoted=F.lit(False))
    )
    earlier = a["start"].isNull() | (top < a["start"])
    closed = same(stack=below, want=ended, start=F.when(earlier, top).otherwise(a["start"]), end=F.when(earlier, after).otherwise(a["end"]), done=F.size(a["stack"]) == 1)
    in_string = (
        F.when(token == '"', same(quoted=F.lit(False), want=F.when(want.isin("key or }", "key"), ":").otherwise(ended)))
        .when((token == "\\") | (token.rlike(r"^[\x00-\x1f]")), failed).otherwise(same())
    )
    outside = (
        F.when(token.rlike(r"^[ \t\n\r]"), same())
        .when((token == '"') & want.isin("key or }", "key", "value", "value or ]"), same(quoted=F.lit(True)))
        .when((token == "{") & value, opened(a["at"], "key or }"))
        .when((token == "[") & value, opened(F.lit(-1).cast("long"), "value or ]"))
        .when((token == "}") & (top >= 0) & want.isin("key or }", "next"), closed)
        .when((token == "]") & (top < 0) & want.isin("value or ]", "next"), same(stack=below, want=ended))
        .when((token == ":") & (want == ":"), same(want=F.lit("value")))
        .when((token == ",") & (want == "next"), same(want=F.when(top >= 0, "key").otherwise("value")))
        .when(value & (token.rlike("^-?[0-9]") | token.isin(*LITERALS)), same(want=ended))
        .otherwise(failed)
    )
    begun = F.when(token == "{", opened(a["at"], "key or }")).otherwise(same())
    return F.when(a["done"], a).when(idle, begun).when(a["quoted"], in_string).otherwise(outside)


def first_object(text: Column) -> Column:
    """(start, end) of the JSON object that begins first in a text, from 0, end exclusive; NULL where there is none.

    It is the first opening brace from which valid JSON can be read, whatever stands
    around it. One pass, whose state is as deep as the objects: 5 MB are as linear as
    5 KB. Not tried again are braces inside what was read as a string of an object
    that failed later. NULL and empty texts have none.
    """
    skipped = F.instr(text, "{") - 1
    none = F.lit(None)
    start = _state(F.lit(0), F.array(), F.lit(""), F.lit(False), none, none, F.lit(False))
    read = lambda t: F.aggregate(F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0)), start, _step)
    found = lambda s: F.when(s["start"].isNotNull(), F.struct((s["start"] + skipped).alias("start"), (s["end"] + skipped).alias("end")))
    return F.when(skipped >= 0, let(read(F.substring(text, skipped + 1, F.length(text))), found))


def embedded_object(text: Column) -> Column:
    """The text of the JSON object that begins first."""
    cut = lambda t, s: F.when(s.isNotNull(), F.substring(t, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return let(text, lambda t: let(first_object(t), lambda s: cut(t, s)))


def without_fence(text: Column) -> Column:
    """Trimmed, without a first line that opens a fence and a last one that closes it."""
    body = F.regexp_replace(text, r"\A\s+|\s+\z", "")
    opened = F.regexp_replace(body, r"\A```[^\n]*(\n|\z)", "")
    return F.when(body.startswith("```"), F.regexp_replace(F.regexp_replace(opened, r"(\A|\n)[ \t]*```[ \t]*\z", ""), r"\A\s+|\s+\z", "")).otherwise(body)


def parsed_response(text: Column) -> Column:
    """(status, payload): what a response holds from its first to its last brace, and whether that is one JSON object.

    Statuses are empty_content, provider_response_mismatch (no braces),
    parse_failure and ok.
    """
    body = without_fence(F.coalesce(text, F.lit("")))
    cut = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    whole = lambda c: let(first_object(c), lambda s: F.coalesce((s["start"] == 0) & (s["end"] == F.length(c)), F.lit(False)))
    answer = lambda status, payload=None: F.struct(F.lit(status).alias("status"), (F.lit(None) if payload is None else payload).cast("string").alias("payload"))
    empty = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "") == ""
    return F.when(empty, answer("empty_content")).otherwise(let(cut, lambda c: F.when(c == "", answer("provider_response_mismatch")).when(whole(c), answer("ok", c)).otherwise(answer("parse_failure"))))
