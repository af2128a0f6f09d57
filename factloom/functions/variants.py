"""Values of varying shape, as VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import let

# Where an item of a message holds structured content, and what never leaves a response.
STRUCTURED_KEYS = ("json", "parsed", "structured_content", "output_json")
REMOVED_KEYS = ("reasoning_details",)


def kind(value: Column) -> Column:
    """object, array, string, boolean, number or null; NULL for NULL."""
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return F.when(name.isin("OBJECT", "ARRAY", "STRING", "BOOLEAN"), F.lower(name)).when(name == "VOID", "null").when(name != "", "number")


def items(value: Column) -> Column:
    """An array's items; NULL for anything else."""
    return F.when(kind(value) == "array", F.try_variant_get(value, "$", "array<variant>"))


def fields(value: Column) -> Column:
    """An object's fields, as a map; NULL for anything else."""
    return F.when(kind(value) == "object", F.try_variant_get(value, "$", "map<string,variant>"))


def shown(value: Column) -> Column:
    """A string as it is, anything else as compact JSON; NULL for null."""
    return F.when(kind(value) == "string", F.try_variant_get(value, "$", "string")).when(kind(value) != "null", F.to_json(value))


def without_keys(json: Column, names: tuple[str, ...] = REMOVED_KEYS) -> Column:
    """Compact JSON, as to_json gives it, without the named keys at any depth.

    A quote inside a string is escaped, so that a name in quotes after a brace or a
    comma is a key. One pass finds what to cut; keys inside a cut go with it.
    """
    return let(json, lambda j: _without_keys(j, names))


def _without_keys(json: Column, names: tuple[str, ...]) -> Column:
    key = "[{,]\"(?:" + "|".join(names) + ")\":"
    token = rf"(?s){key}|\\.|[\"{{}}\[\],]|[^\"\\{{}}\[\],]++"
    long = lambda c: c.cast("long")

    def state(at, depth, quoted, since, level, cuts):
        return F.struct(long(at).alias("at"), long(depth).alias("depth"), quoted.alias("quoted"), long(since).alias("since"), long(level).alias("level"), cuts.cast("array<struct<s:long,e:long>>").alias("cuts"))

    def step(a: Column, t: Column) -> Column:
        after = a["at"] + F.length(t)
        same = lambda **c: state(*[c.get(x, after if x == "at" else a[x]) for x in ("at", "depth", "quoted", "since", "level", "cuts")])
        is_key, brace = F.length(t) > 2, F.left(t, F.lit(1)) == "{"
        is_key = is_key & t.rlike("^" + key)
        cut = lambda end: F.concat(a["cuts"], F.array(F.struct(a["since"].alias("s"), long(end).alias("e"))))
        nothing = F.lit(None)
        deeper, level = a["depth"] + 1, a["depth"] == a["level"]
        # a cut that began after a brace takes the comma that follows
        comma = F.when(F.element_at(F.split(F.substring(json, (a["since"]).cast("int"), F.lit(1)), ""), 1) == "{", after).otherwise(a["at"])
        in_cut = (
            F.when((t == ",") & level, same(cuts=cut(comma), since=nothing, level=nothing))
            .when((t == "}") & level, same(cuts=cut(a["at"]), since=nothing, level=nothing, depth=a["depth"] - 1))
            .when(is_key & brace | t.isin("{", "["), same(depth=deeper)).when(t.isin("}", "]"), same(depth=a["depth"] - 1)).otherwise(same())
        )
        free = (
            F.when(is_key & brace, same(since=a["at"] + 1, depth=deeper, level=deeper)).when(is_key, same(since=a["at"], level=a["depth"]))
            .when(t.isin("{", "["), same(depth=deeper)).when(t.isin("}", "]"), same(depth=a["depth"] - 1)).otherwise(same())
        )
        return F.when(t == '"', same(quoted=~a["quoted"])).when(a["quoted"], same()).when(a["since"].isNotNull(), in_cut).otherwise(free)

    start = state(F.lit(0), F.lit(0), F.lit(False), F.lit(None), F.lit(None), F.array())
    cuts = F.aggregate(F.regexp_extract_all(json, F.lit(token), F.lit(0)), start, step, lambda a: a["cuts"])
    piece = lambda s, e: F.substring(json, (s + 1).cast("int"), (e - s).cast("int"))
    kept = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    joined = F.aggregate(cuts, kept, lambda a, c: F.struct(F.concat(a["out"], piece(a["at"], c["s"])).alias("out"), c["e"].alias("at")), lambda a: F.concat(a["out"], F.substring(json, (a["at"] + 1).cast("int"), F.length(json))))
    return F.when(json.rlike(key), joined).otherwise(json)


def cleaned(value: Column) -> Column:
    """A value as compact JSON without the keys that never leave a response."""
    return without_keys(F.to_json(value))


def _held(item: Column) -> Column:
    """What an item holds under the first of the structured keys that it has, as compact JSON; text that is JSON is read."""
    name = lambda parts: F.get(F.filter(F.array(*[F.lit(k) for k in STRUCTURED_KEYS]), lambda k: F.map_contains_key(parts, k)), F.lit(0))
    text = lambda v: F.when(kind(v) == "string", F.trim(F.try_variant_get(v, "$", "string")))
    read = lambda v: let(text(v), lambda x: F.when(x.rlike(r"^[{\[]"), F.try_parse_json(x)))
    value = let(fields(item), lambda parts: let(name(parts), lambda k: F.when(k.isNotNull(), F.element_at(parts, k))))
    return let(value, lambda v: F.when(kind(v) != "null", cleaned(F.coalesce(read(v), v))))


def message_text(content: Column) -> Column:
    """A message's content as text: strings as they are, objects as compact JSON, of a list each item's text, structured content or JSON, line by line, without empty ones."""
    of_object = lambda x: F.coalesce(let(F.try_variant_get(x, "$.text", "variant"), shown), _held(x), F.to_json(x))
    said = lambda x: let(kind(x), lambda k: F.when(k == "object", of_object(x)).otherwise(shown(x)))
    lines = F.filter(F.transform(items(content), said), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.coalesce(F.when(kind(content) == "array", F.array_join(lines, "\n")).otherwise(shown(content)), F.lit(""))


def structured_content(content: Column, parsed: Column | None = None) -> Column:
    """Structured content as compact JSON: what the provider parsed, else the content if it is an object, else the first item that holds some; NULL without."""
    of_list = F.get(F.filter(F.transform(items(content), _held), lambda x: x.isNotNull()), F.lit(0))
    own = F.when(kind(content) == "object", cleaned(content)).otherwise(of_list)
    return own if parsed is None else F.coalesce(F.when(kind(parsed) != "null", cleaned(parsed)), own)
