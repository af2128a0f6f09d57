"""Secret scans with multipart credential linking, in DataFrame operations only.

Strong patterns (the kinds of ``BASE``) are reported wherever they stand. Weak
candidates (identifiers, secrets and endpoints that mean little alone) are
reported only where complementary parts stand within one scope, a stretch of
``reach`` code points. An interval join finds these: every part is dealt to the
bins of ``reach`` code points that it touches, every candidate to the bins that
its widened interval touches, and parts meet candidates of their own text and
bin, so that no part meets all others of its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.scratch import Scratch, broadcast_if_small

from .text import field_of, let, rows_of, running

#: kind, pattern, group whose length counts, its least length; in the order in which kinds are listed. Keywords are matched in either case, here and below.
BASE = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
WEAK = (
    ("weak_id", r"""((?i:user|username|login|client_id|account_id|key_id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)""", 2, 3),
    ("weak_secret", r"""((?i:pass|pwd|auth|credential|signature|private_key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("weak_block", r"""(?<![A-Za-z0-9+/=])([A-Za-z0-9+/]{40})(?![A-Za-z0-9+/=])""", 0, 40),
    ("weak_endpoint", r"""((?i:https?|postgres|mysql|mongodb|redis|amqp|ftp))://([A-Za-z0-9._:/-]+)""", 0, 10),
)
#: The part that a kind plays.
ROLE = {"assign": "secret", "hex": "secret", "access": "id", "weak_id": "id", "weak_secret": "secret", "weak_block": "secret", "weak_endpoint": "endpoint"}
#: What a reported weak candidate is called, and the roles that must stand near it.
LINKED = {"weak_id": ("linked_id", ("secret",)), "weak_secret": ("linked_secret", ("id", "endpoint")), "weak_block": ("linked_secret", ("id", "endpoint")), "weak_endpoint": ("linked_endpoint", ("id", "secret"))}
ORDER = ("assign", "access", "hex", "linked_id", "linked_secret", "linked_endpoint")
SPAN = "array<struct<s:int,e:int,kind:string>>"


def spans_of(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost matches without overlap, as spans in code points; those whose group is too short are dropped after matching.

    What lies between matches comes from a split on the same pattern, so that
    positions are sums of lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    rows = F.zip_with(F.arrays_zip(found.alias("m"), sized.alias("g")), F.slice(gaps, 1, F.size(found)), lambda x, gap: F.struct(F.length(gap).alias("gap"), F.length(x["m"]).alias("m"), F.length(x["g"]).alias("g")))

    def placed(rows: Column) -> Column:
        ends = running(F.transform(rows, lambda x: (x["gap"] + x["m"]).cast("long")), lambda a, b: a + b)
        spans = F.zip_with(rows, ends, lambda x, e: F.struct((e - x["m"]).cast("int").alias("s"), e.cast("int").alias("e"), F.lit(kind).alias("kind"), (x["g"] >= least).alias("ok")))
        return F.transform(F.filter(spans, lambda x: x["ok"]), lambda x: x.dropFields("ok"))

    return F.when(text.rlike(pattern), let(rows, placed)).otherwise(F.array().cast(SPAN))


def _link(parts: DataFrame, reach: int) -> DataFrame:
    """The weak parts that have their complements within reach, renamed."""
    dealt = parts.withColumn("bin", F.explode(F.expr(f"sequence(s div {reach}, (e - 1) div {reach})")))
    roles = F.create_map(*[F.lit(x) for k, v in ROLE.items() for x in (k, v)])
    near = dealt.select("doc_id", "key", "bin", F.col("s").alias("s2"), F.col("e").alias("e2"), roles[F.col("kind")].alias("role"))
    asks = parts.filter(F.col("kind").isin(*LINKED)).withColumn("bin", F.explode(F.expr(f"sequence(greatest(s - {reach}, 0) div {reach}, (e - 1 + {reach}) div {reach})")))
    on = [asks.doc_id.eqNullSafe(near.doc_id), asks.key == near.key, asks.bin == near.bin, near.s2 <= asks.e + reach, near.e2 >= asks.s - reach]
    met = asks.join(near, on).groupBy(asks.doc_id, asks.key, "s", "e", "kind").agg(F.collect_set("role").alias("roles"))
    # an endpoint needs both other parts, the others any one of theirs
    ok = F.lit(False)
    for kind, (_, need) in LINKED.items():
        has = [F.array_contains("roles", r) for r in need]
        ok = ok | ((F.col("kind") == kind) & ((has[0] & has[1]) if kind == "weak_endpoint" else (has[0] if len(has) == 1 else has[0] | has[1])))
    names = F.create_map(*[F.lit(x) for k, (v, _) in LINKED.items() for x in (k, v)])
    return met.filter(ok).select("doc_id", "key", "s", "e", names[F.col("kind")].alias("kind"))


def _joined(spans: Column) -> Column:
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(ORDER) for x in (k, i)])
    rows = F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), rank[x["kind"]].alias("r"), x["e"].alias("e"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, *, reach: int = 160) -> DataFrame:
    """One row per document: doc_id, key, base (array of spans), linked (array of spans).

    docs: doc_id, text; other columns aren't read. key tells apart texts of one
    doc_id. Defined results: NULL and empty texts have no spans; a NULL doc_id is
    an id like any other; repeated rows give repeated results; an empty table
    gives an empty result; spans of different kinds may overlap.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    text = F.col("_t")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    found = found.select(
        "doc_id", F.xxhash64("_t", F.length("_t")).alias("key"),
        F.concat(*[spans_of(text, *b) for b in BASE]).alias("base"),
        F.concat(*[spans_of(text, *b) for b in WEAK]).alias("weak"),
    )
    found = scratch.table(found)
    parts = found.filter((F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1)).select("doc_id", "key", F.explode(F.concat("base", "weak")).alias("p")).select("doc_id", "key", "p.*").distinct()
    links = _link(parts, reach).groupBy("doc_id", "key").agg(F.collect_set(F.struct("s", "e", "kind")).alias("linked"))
    links = links.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "linked")
    out = found.join(links, found.doc_id.eqNullSafe(F.col("_d")) & (found.key == F.col("_k")), "left")
    return out.select("doc_id", "key", "base", F.coalesce("linked", F.array().cast(SPAN)).alias("linked"))


def digest(scanned: DataFrame) -> DataFrame:
    """The spans as text, with counts and the hash of the base ones."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "linked")).alias("spans"),
    )


def _apart(spans: Column) -> Column:
    """(s, e) of the spans in order, overlapping ones merged, touching ones not."""

    def merged(x: Column) -> Column:
        def cut(ends: Column) -> Column:
            first = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i)["s"] >= F.get(ends, i - 1)))
            return let(first, lambda f: F.transform(f, lambda i, k: F.struct(F.get(x, i)["s"].alias("s"), F.get(ends, F.coalesce(F.get(f, k + 1), F.size(x)) - 1).cast("int").alias("e"))))

        return let(running(F.transform(x, lambda v: v["e"].cast("long")), F.greatest), cut)

    return let(F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))), merged)


def redact(text: Column, spans: Column, mask: str = "[REDACTED]") -> Column:
    """The text with every span, overlapping ones merged, replaced by the mask; NULL stays NULL.

    Places are code points, which have to be counted from the text's beginning:
    stretches of the text, then of a stretch, are taken out first, so that the
    work doesn't grow as spans times length.
    """

    def masked(part: Column, begin: Column, x: Column, bunches: tuple[int, ...]) -> Column:
        """The part, which begins at code point ``begin`` and holds the spans x."""
        n = F.size(x)
        if not bunches:
            gap = lambda i: let(
                F.when(i == 0, begin).otherwise(F.get(x, i - 1)["e"]), lambda a: part.substr(a - begin + 1, F.when(i == n, F.length(part) + begin).otherwise(F.get(x, i)["s"]) - a)
            )
            return F.array_join(F.transform(F.sequence(F.lit(0), n), gap), mask)
        size = bunches[0]
        first = lambda i: F.when(i == 0, begin).otherwise(F.get(x, i * size)["s"])
        after = lambda i: F.when((i + 1) * size >= n, F.length(part) + begin).otherwise(F.get(x, (i + 1) * size)["s"])
        one = lambda i: let(first(i), lambda a: let(part.substr(a - begin + 1, after(i) - a), lambda p: let(F.slice(x, i * size + 1, F.lit(size)), lambda y: masked(p, a, y, bunches[1:]))))
        return F.array_join(F.transform(F.sequence(F.lit(0), ((n - 1) / size).cast("int")), one), "")

    whole = let(_apart(spans), lambda x: let(text, lambda t: masked(t, F.lit(0), x, (8192, 128))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def redact_secrets(docs: DataFrame, *, reach: int = 160, mask: str = "[REDACTED]") -> DataFrame:
    """The documents' rows, all columns, with every span in text masked and n_chars, where there is one, set anew.

    Only the texts with spans are changed. Their spans are broadcast if they are
    few, and joined by a shuffle of all texts otherwise.
    """
    scratch = Scratch(docs.sparkSession, "redact")
    found = scan(docs, reach=reach).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), F.concat("base", "linked").alias("_spans")).filter(F.size("_spans") > 0)
    found = scratch.table(found.dropDuplicates(["_d", "_k"]))
    few = broadcast_if_small(found, found.agg(F.coalesce(F.sum(1 + F.size("_spans")), F.lit(0))).first()[0])
    text = F.coalesce(field_of("text"), F.lit(""))
    rows = rows_of(docs).withColumn("key", F.xxhash64(text, F.length(text)))
    out = rows.join(few, field_of("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left")
    hit = F.col("_spans").isNotNull()
    out = out.select("row", hit.alias("hit"), F.when(hit, redact(field_of("text"), F.col("_spans"), mask)).alias("masked"))
    changed = F.col("row").withField("text", F.when(F.col("hit"), F.col("masked")).otherwise(field_of("text")))
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.when(F.col("hit"), F.length("masked").cast(docs.schema["n_chars"].dataType)).otherwise(field_of("n_chars")))
    return out.select(changed.alias("row")).select("row.*")
