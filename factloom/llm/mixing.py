"""Mixing sources to target weights, in DataFrame operations only.

Targets: sources in code point order (NULL last) have weights that repeat; they
share the total size, no target above ``cap`` times its source's size, and what
is cut is shared again by weight (water filling).

A source's documents, ordered by a hash, form a permuted stream of words, cut
into blocks. Whole passes over it take every block; a last pass takes a part of
its blocks, so that the target is met to half a block. Every pass over a source
is a stratum of so many blocks, of which so many are to be taken. A splitting
tree halves the output shards: at each node the exact block quotas of all strata
are split by a multivariate hypergeometric draw, as if all blocks to be taken had
been shuffled and dealt, and the blocks to be left out are halved. A shard then
takes its quota from its own stretch of each stratum's permuted blocks, so that
shards are disjoint and the draws decide which blocks are left out, and shuffles
what it got by a hash of its own.

The tree holds as many rows as there are shards, each with a number for every
stratum; sources are named groups of documents, some thousands at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.scratch import Scratch, broadcast_if_small

from .text import array_sum, excerpt, field_of, let, rows_of, words


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Of ``drawn`` from ``total`` with ``marked`` ones, how many are marked: inverse transform of u in [0, 1).

    Outcomes are walked from the mode up, then down; weights follow from their
    ratios, over 12 standard deviations and 30 more on either side.
    """
    start = F.struct(total.cast("double").alias("total"), marked.cast("double").alias("marked"), drawn.cast("double").alias("drawn"), u.alias("u"))

    def with_range(v: Column) -> Column:
        n, k, d = v["total"], v["marked"], v["drawn"]
        low, high = F.greatest(F.lit(0.0), d + k - n), F.least(d, k)
        mode = F.greatest(low, F.least(high, F.floor((d + 1) * (k + 1) / (n + 2)).cast("double")))
        share = k / F.greatest(n, F.lit(1.0))
        reach = F.ceil(12 * F.sqrt(F.greatest(d * share * (1 - share), F.lit(0.0)))).cast("double") + 30
        return F.struct(
            n.alias("total"), k.alias("marked"), d.alias("drawn"), v["u"].alias("u"), mode.alias("m"),
            F.least(high - mode, reach).cast("int").alias("up"), F.least(mode - low, reach).cast("int").alias("down"),
        )

    def rise(v: Column, i: Column) -> Column:
        x = v["m"] + i
        return (v["marked"] - x) * (v["drawn"] - x) / ((x + 1) * F.greatest(v["total"] - v["marked"] - v["drawn"] + x + 1, F.lit(1.0)))

    def fall(v: Column, i: Column) -> Column:
        x = v["m"] - i
        return x * (v["total"] - v["marked"] - v["drawn"] + x) / ((v["marked"] - x + 1) * (v["drawn"] - x + 1))

    def walk(v: Column, steps: Column, ratio, limit: Column | None) -> Column:
        """Sum of the weights, or how many of them stay within the limit in all."""
        zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), F.lit(0).alias("k"))

        def step(a: Column, i: Column) -> Column:
            s = a["s"] + a["w"]
            k = a["k"] if limit is None else F.when(s <= limit, a["k"] + 1).otherwise(a["k"])
            return F.struct((a["w"] * ratio(v, i)).alias("w"), s.alias("s"), k.alias("k"))

        return F.aggregate(F.sequence(F.lit(0), steps), zero, step, lambda a: a["s"] if limit is None else a["k"])

    def draw(v: Column) -> Column:
        sums = F.struct(walk(v, v["up"], rise, None).alias("a"), (walk(v, v["down"], fall, None) - 1).alias("b"))

        def pick(s: Column) -> Column:
            t = v["u"] * (s["a"] + s["b"])
            # the walk down starts at the mode again, whose weight is 1
            up = v["m"] + F.least(walk(v, v["up"], rise, t), v["up"])
            down = v["m"] - F.least(F.greatest(walk(v, v["down"], fall, t - s["a"] + 1), F.lit(1)), v["down"])
            return F.when(t < s["a"], up).otherwise(down)

        return let(sums, pick)

    return let(let(start, with_range), draw).cast("long")


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def split_quotas(node: Column, quotas: Column, drawn: Column, seed: int) -> Column:
    """How many of each quota go left, ``drawn`` in all: one after another, hypergeometric given those before."""

    def step(a: Column, x: Column) -> Column:
        got = let(hypergeometric(a["total"], x["q"], a["drawn"], _uniform(F.lit(seed), node, x["i"])), lambda g: F.greatest(F.least(g, x["q"], a["drawn"]), a["drawn"] + x["q"] - a["total"], F.lit(0).cast("long")))
        return let(got, lambda g: F.struct((a["total"] - x["q"]).alias("total"), (a["drawn"] - g).alias("drawn"), F.concat(a["out"], F.array(g)).alias("out")))

    start = F.struct(array_sum(quotas).alias("total"), drawn.cast("long").alias("drawn"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(F.transform(quotas, lambda q, i: F.struct(q.alias("q"), i.alias("i"))), start, step, lambda a: a["out"])


def source_targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(source, source_size, rank, target) from (source, source_size): one row per source throughout."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("w", w)
    ranked = ranked.withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w"))
    every = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, 0)
    level = (F.sum("source_size").over(every) - (F.sum("most").over(by_ratio) - F.col("most"))) / (F.sum("w").over(every) - (F.sum("w").over(by_ratio) - F.col("w")))
    ranked = ranked.withColumn("level", level)
    # the first source, by ratio, that the water level leaves below its cap
    first = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank"))).over(every)
    return ranked.withColumn("final", first).select("source", "source_size", "rank", F.least("most", F.coalesce(F.col("final") * F.col("w"), F.lit(0.0))).alias("target"))


def _tree(strata: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, stratum, quota, left_out): blocks of each stratum (stratum, blocks, quota) for each shard."""
    held = F.sort_array(F.collect_list(F.struct("stratum", "quota", (F.col("blocks") - F.col("quota")).alias("rest"))))
    tree = strata.agg(held.alias("x")).select(F.lit(0).cast("long").alias("shard"), F.lit(shards).cast("long").alias("n"), F.transform("x", lambda x: x["quota"]).alias("quotas"), F.transform("x", lambda x: x["rest"]).alias("rests"))
    half = F.floor((F.col("n") + 1) / 2).cast("long")
    part = lambda total: F.floor(total.cast("decimal(38,0)") * F.col("half") / F.col("n")).cast("long")
    for level in range((shards - 1).bit_length()):
        split = tree.withColumn("half", half).withColumn("left", F.when(F.col("n") > 1, split_quotas(F.col("shard") * 64 + level, F.col("quotas"), part(array_sum(F.col("quotas"))), seed)))
        split = split.withColumn("spared", F.transform("rests", part))
        less = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
        halves = F.array(
            F.struct("shard", F.col("half").alias("n"), F.col("left").alias("quotas"), F.col("spared").alias("rests")),
            F.struct((F.col("shard") + F.col("half")).alias("shard"), (F.col("n") - F.col("half")).alias("n"), less("quotas", "left").alias("quotas"), less("rests", "spared").alias("rests")),
        )
        tree = split.select(F.explode(F.when(F.col("n") > 1, halves).otherwise(F.array(F.struct("shard", "n", "quotas", "rests")))).alias("x")).select("x.*")
        if level == 6:
            tree = tree.repartition("shard")
    return tree.select("shard", F.posexplode(F.arrays_zip("quotas", "rests")).alias("stratum", "x")).select("shard", "stratum", F.col("x.quotas").alias("quota"), F.col("x.rests").alias("left_out"))


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0, shard_words: int = 1 << 17, block_words: int = 1024, seed: int = 17, bucket_rows: int = 20_000) -> DataFrame:
    """One row per document and stretch that a shard takes of it; documents that no shard takes have one row with words 0.

    Columns: doc_id, key (of the text), source, at (place in the source's stream, apart for documents
    with words), size, source_size, target, pass, shard, position (order in the
    shard), word_from, words. A block has ``block_words`` words, or the 512th part
    of its source if that is less. docs: doc_id, text, source; other columns aren't
    read. Defined results: NULL texts have size 0, and nothing is taken of a
    document without words; a NULL source is the last source; repeated rows are
    documents of their own; an empty table, and one without words, is not taken
    from. Equal tables and parameters give equal results.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.col("source").cast("string").alias("source"), F.size(words(F.col("text"))).cast("long").alias("size"))
    rows = scratch.table(rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "key", "size")))
    bits = max(6, (rows.count() // bucket_rows).bit_length())
    rows = rows.withColumn("b", F.shiftrightunsigned("h", 64 - bits))
    buckets = scratch.table(rows.groupBy("source", "b").agg(F.sum("size").alias("n")))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("n").alias("source_size")), weights, cap).withColumn("quota", F.round("target").cast("long"))
    targets = targets.withColumn("block", F.least(F.lit(block_words).cast("long"), F.expr("greatest(1L, source_size div 512)"))).withColumn("full", F.expr("if(source_size > 0, quota div source_size * source_size, 0L)"))
    targets = scratch.table(targets)
    n_sources, total = targets.agg(F.count("*"), F.coalesce(F.sum("quota"), F.lit(0))).first()
    small = broadcast_if_small(targets.withColumnRenamed("source", "_s"), n_sources)
    before = buckets.select(
        F.col("source").alias("_s2"), F.col("b").alias("_b"), (F.sum("n").over(Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("_before")
    )
    inner = F.sum("size").over(Window.partitionBy("source", "b").orderBy("h", "doc_id", "key", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = rows.withColumn("_in", inner).join(before, F.col("source").eqNullSafe(F.col("_s2")) & (F.col("b") == F.col("_b")))
    placed = placed.join(small, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "key", "source", "rank", (F.col("_in") + F.col("_before")).alias("at"), "size", "source_size", "target", "quota", "full")
    placed = scratch.table(placed)

    shards = max(1, -(-total // shard_words))
    # whole passes are stratum 2 * rank, the last pass is the next one; base: where it begins in the stream
    strata = targets.select("rank", "block", F.explode(F.array(
        F.struct((2 * F.col("rank")).alias("stratum"), F.ceil(F.col("full") / F.col("block")).cast("long").alias("blocks"), F.ceil(F.col("full") / F.col("block")).cast("long").alias("quota"), F.lit(0).cast("long").alias("base"), F.col("full").alias("end")),
        F.struct(
            (2 * F.col("rank") + 1).alias("stratum"), F.ceil(F.col("source_size") / F.col("block")).cast("long").alias("blocks"), F.round((F.col("quota") - F.col("full")) / F.col("block")).cast("long").alias("quota"),
            F.col("full").alias("base"), (F.col("full") + F.col("source_size")).alias("end"),
        ),
    )).alias("x")).select("rank", "block", "x.*")
    strata = scratch.table(strata.withColumn("quota", F.least("quota", "blocks")))
    got = scratch.table(_tree(strata, shards, seed))
    upto = F.sum(F.col("quota") + F.col("left_out")).over(Window.partitionBy("stratum").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    ranges = got.select("shard", "stratum", "quota", (upto - F.col("quota") - F.col("left_out")).alias("first")).filter("quota > 0")
    of = broadcast_if_small(strata.select("stratum", "rank", "block", "base", "end"), 2 * n_sources)
    ranges = ranges.join(of, "stratum").select(
        "shard", F.col("rank").alias("_rank"), (F.col("base") + F.col("first") * F.col("block")).alias("lo"), F.least("end", F.col("base") + (F.col("first") + F.col("quota")) * F.col("block")).alias("hi")
    )
    # interval join by bins of a shard's usual stretch of the source
    sizes = broadcast_if_small(targets.select(F.col("rank").alias("_r2"), F.col("quota").alias("_q2")), n_sources)
    width = lambda quota: F.greatest(F.lit(block_words).cast("long"), F.ceil(quota / shards).cast("long"))
    bins = ranges.join(sizes, F.col("_rank") == F.col("_r2")).withColumn("_w", width(F.col("_q2"))).select("shard", "_rank", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / F.col("_w")), F.floor((F.col("hi") - 1) / F.col("_w")))).alias("_bin"))
    passes = placed.filter("size > 0 and quota > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("full div source_size")))).withColumn("_w", width(F.col("quota")))
    passes = passes.withColumn("a", F.col("pass") * F.col("source_size") + F.col("at")).withColumn("z", F.col("a") + F.col("size"))
    passes = passes.withColumn("_bin2", F.explode(F.sequence(F.floor(F.col("a") / F.col("_w")), F.floor((F.col("z") - 1) / F.col("_w")))))
    met = passes.join(bins, (F.col("rank") == F.col("_rank")) & (F.col("_bin2") == F.col("_bin")) & (F.col("a") < F.col("hi")) & (F.col("z") > F.col("lo")))
    # a pair that meets in several bins counts in the first
    met = met.filter(F.col("_bin") == F.greatest(F.floor(F.col("a") / F.col("_w")), F.floor(F.col("lo") / F.col("_w"))))
    cut_from = F.greatest("a", "lo")
    names = ["doc_id", "key", "source", "at", "size", "source_size", "target"]
    taken = scratch.table(met.select(
        *names, "pass", "shard", F.xxhash64(F.lit(seed + 1), "shard", "source", "a").alias("position"), (cut_from - F.col("a")).alias("word_from"), (F.least("z", "hi") - cut_from).alias("words"),
    ))
    some = taken.select(F.col("source").alias("_s"), F.col("at").alias("_at")).distinct()
    none = placed.join(some, F.col("source").eqNullSafe(F.col("_s")) & (F.col("at") == F.col("_at")) & (F.col("size") > 0), "left_anti")
    nothing = F.lit(None).cast("long")
    return taken.unionByName(none.select(*names, *[nothing.alias(c) for c in ("pass", "shard", "position")], *[F.lit(0).cast("long").alias(c) for c in ("word_from", "words")]))


def words_taken(mixed: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, stretches. Documents with words are told apart by their place in the stream.

    stretches: shard:position:pass:word_from:words of all that is taken, in order, comma-joined.
    """
    names = ["doc_id", "size", "source_size", "target", "taken", "stretches"]
    order = ["shard", "position", "pass", "word_from", "words"]
    parts = F.sort_array(F.collect_list(F.when(F.col("words") > 0, F.struct(*order))))
    text = F.array_join(F.transform(parts, lambda x: F.concat_ws(":", *[x[c].cast("string") for c in order])), ",")
    some = mixed.filter("size > 0").groupBy("source", "at").agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.sum("words").alias("taken"), text.alias("stretches"))
    return some.select(*names).unionByName(mixed.filter("size = 0").withColumn("taken", F.col("words")).withColumn("stretches", F.lit("")).select(*names))


def _whole(stretches: Column) -> Column:
    """Stretches (a, n) in order, those that touch as one."""
    kind = "array<struct<a:bigint,n:bigint>>"

    def step(held: Column, x: Column) -> Column:
        last = F.element_at(held, -1)
        touches = (F.size(held) > 0) & (F.try_element_at(held, F.lit(-1))["a"] + F.try_element_at(held, F.lit(-1))["n"] == x["a"])
        return F.when(touches, F.concat(F.slice(held, F.lit(1), F.size(held) - 1), F.array(F.struct(last["a"].alias("a"), (last["n"] + x["n"]).alias("n"))))).otherwise(F.concat(held, F.array(F.struct(x["a"].alias("a"), x["n"].alias("n")))))

    return F.aggregate(F.sort_array(stretches), F.array().cast(kind), step)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix with the documents' columns: a document once for each stretch that a pass takes of it, its text cut to the words taken, white space between them as it was.

    Rows with equal doc_id, text and source but other columns that differ count
    each; all that is taken of them is given with the columns of any one of them.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    got = mix(docs, **options).filter("words > 0").groupBy("doc_id", "key", "source", "at", "size", "pass").agg(F.collect_list(F.struct(F.col("word_from").alias("a"), F.col("words").alias("n"))).alias("x"))
    got = got.select("doc_id", "key", "source", "size", F.explode(_whole(F.col("x"))).alias("x")).select("doc_id", "key", "source", "size", "x.a", "x.n")
    takes = scratch.table(got.groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), F.col("source").alias("_s")).agg(F.collect_list(F.struct("a", "n", "size")).alias("_takes")))
    rows = rows_of(docs).select("row", F.xxhash64(field_of("text")).alias("key"))
    same = ["row.doc_id", "key", "row.source"]
    # repeated rows share one list of takes
    if not rows.groupBy(*same).count().filter("count > 1").isEmpty():
        rows = rows.withColumns({"d": field_of("doc_id"), "s": field_of("source")}).dropDuplicates(["d", "key", "s"]).select("row", "key")
    on = field_of("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")) & field_of("source").cast("string").eqNullSafe(F.col("_s"))
    out = rows.join(takes, on).withColumn("take", F.explode("_takes"))
    text, take = field_of("text"), F.col("take")
    cut = excerpt(text, take["a"], take["n"])
    whole = take["n"] == take["size"]
    changed = F.col("row").withField("text", F.when(whole, text).otherwise(cut))
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.when(whole, field_of("n_chars")).otherwise(F.length(cut).cast(docs.schema["n_chars"].dataType)))
    return out.select(changed.alias("row")).select("row.*")
