"""Removal of repeated passages with merged Burrows-Wheeler transforms.

A byte goes if a string of ``window`` bytes that covers it also starts anywhere
else. Every window has a key, the least hash of its 32-byte grams (the leftmost
of equals), and equal windows have equal keys at equal places. Consecutive
windows with one key place form a run; runs whose key occurs once hold no repeat.
Of the others, one context per key and distinct text is read, with the number of
its copies, and cut into 16-byte blocks counted from the key. A task deals the
contexts of its keys to shards, builds each shard's Burrows-Wheeler transform and
merges the transforms by iterative interleave refinement: after h rounds the
interleaving is sorted by h blocks, and the boundaries found so far say which
neighbours share h blocks, so that no suffix is sorted again. Intervals of eleven
blocks in common that hold two occurrences or more, with the up to 24 bytes around
them, give the repeated windows exactly.

Contexts of a key that very many texts share are dealt by a second key, the least
hash of the blocks inside a window, then by a third, so that such a key is spread
over tasks; equal windows stay together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.scratch import Scratch

GRAM, BLOCK = 32, 16
_random = np.random.default_rng(20)
_TABLE = _random.integers(0, 2**64, 256, dtype=np.uint64)
_FACTORS = _random.integers(0, 2**63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all 32-byte grams, by doubling."""
    h, n = _TABLE[data], 1
    for m in _FACTORS:
        h = h[:-n] * m + h[n:]
        h ^= h >> np.uint64(29)
        n *= 2
    return h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    rest = width - n
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def runs_of(data: bytes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, first window, windows and the key's place from the first window, of each run."""
    if len(data) < window:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none
    h = gram_hashes(np.frombuffer(data, np.uint8))
    least = sliding_min(h, window - GRAM + 1)
    leave = h[: len(least)] == least  # the next window no longer holds this place
    cut = np.flatnonzero((least[1:] != least[:-1]) | leave[:-1]) + 1
    start = np.concatenate(([0], cut))
    size = np.diff(np.concatenate((start, [len(least)])))
    key = least[start]
    place = np.zeros(len(start), np.int64)
    # the key's place is where the run's last window, or a later gram, holds it first
    last = start + size - 1
    ends = leave[last]
    place[ends] = last[ends]
    for i in np.flatnonzero(~ends).tolist():
        s = int(start[i])
        place[i] = s + int(np.argmin(h[s : s + window - GRAM + 1]))
    return key, start, size, place - start


def shard_transform(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and transform of a shard whose texts end in symbols of their own, by prefix doubling."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    step = 1
    while rank.max(initial=0) + 1 < n:
        pair = rank * (n + 1) + np.concatenate((rank[step:] + 1, np.zeros(min(step, n), np.int64)))[:n]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, symbols[order - 1]


def merged_blocks(shards: list[tuple[np.ndarray, np.ndarray]], depth: int) -> list[np.ndarray]:
    """For every suffix of every shard, the number of its class of equal first ``depth`` symbols, by interleave refinement."""
    sizes = [len(o) for o, _ in shards]
    letters = np.concatenate([t for _, t in shards])
    z = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) < 256 else np.int32), sizes)
    block = np.zeros(len(z), np.int64)
    for _ in range(depth):
        # a shard's letters come in its own order, wherever the interleaving puts them
        place = np.argsort(z, kind="stable")
        c = np.empty_like(letters)
        c[place] = letters
        to = np.argsort(c, kind="stable")
        z, c, b = z[to], c[to], block[to]
        block = np.concatenate(([0], np.cumsum((c[1:] != c[:-1]) | (b[1:] != b[:-1]))))
    place = np.argsort(z, kind="stable")
    out, at = [], 0
    for (order, _), n in zip(shards, sizes, strict=True):
        mine = np.empty(n, np.int64)
        mine[order] = block[place[at : at + n]]
        out.append(mine)
        at += n
    return out


def _words(data: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """The n bytes at every place, n a multiple of 8, as numbers of eight bytes."""
    out = []
    for first in range(0, n, 8):
        word = np.zeros(len(at), np.uint64)
        for t in range(first, first + 8):
            word = word << np.uint64(8) | data[at + t]
        out.append(word)
    return out


def _blocks(contexts: list[bytes], places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All blocks counted from the keys: the bytes of all contexts, where each context begins, and each block's begin, context and number in it."""
    first = places % BLOCK
    sizes = np.array([len(c) for c in contexts])
    blocks = np.maximum(sizes - first, 0) // BLOCK
    base = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(len(contexts)), blocks)
    index = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    data = np.frombuffer(b"".join(contexts) + b"\0" * 64, np.uint8)
    return data, base, base[owner] + first[owner] + index * BLOCK, owner, index


def repeated_windows(contexts: list[bytes], places: np.ndarray, counts: np.ndarray, window: int, copies: np.ndarray | None = None, shards: int = 4) -> list[np.ndarray]:
    """For each context, which of its windows occur twice or more at the same distance from the key; copies: how often each context occurs."""
    m = len(contexts)
    copies = np.ones(m, np.int64) if copies is None else copies
    masks = [np.zeros(int(n), bool) for n in counts]
    depth = (window - BLOCK) // BLOCK
    edge = window - depth * BLOCK
    data, base, begin, owner, index = _blocks(contexts, places)
    blocks = np.bincount(owner, minlength=m)
    symbol = np.zeros(len(begin), np.int64)
    for word in _words(data, begin, BLOCK):
        distinct, number = np.unique(word, return_inverse=True)
        symbol = np.unique(symbol * len(distinct) + number, return_inverse=True)[1].astype(np.int64)
    symbol += m
    deal = np.arange(m) % shards
    built, texts = [], []
    stop = np.cumsum(blocks)
    for s in range(shards):
        ids = np.flatnonzero(deal == s)
        if not len(ids):
            continue
        # every text ends in a symbol of its own
        long = blocks[ids] + 1
        where = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long) + np.repeat(stop[ids] - blocks[ids], long)
        last = np.cumsum(long) - 1
        where[last] = -1
        symbols = np.where(where >= 0, symbol[where] if len(symbol) else 0, 0)
        symbols[last] = ids
        built.append(shard_transform(symbols))
        texts.append(where)
    classes = np.full(len(begin), -1, np.int64)
    for got, where in zip(merged_blocks(built, depth), texts, strict=True):
        classes[where[where >= 0]] = got[where >= 0]
    whole = np.flatnonzero(index + depth <= blocks[owner])
    if not len(whole):
        return masks
    _, inverse, members = np.unique(classes[whole], return_inverse=True, return_counts=True)
    occurrences = np.bincount(inverse, copies[owner[whole]])
    often = occurrences[inverse] > 1
    alone = often & (copies[owner[whole]] > 1)  # an interval with two occurrences whatever stands around it
    shared = often & ~alone & (members[inverse] > 1)
    flat = np.concatenate(([0], np.cumsum(counts)))
    hits = np.zeros(int(flat[-1]), bool)
    both = whole[alone | shared]
    group, mine = inverse[alone | shared], alone[alone | shared]
    for k in range(BLOCK):
        p = begin[both] - base[owner[both]] - k
        ok = (p >= 0) & (p < counts[owner[both]])
        to = flat[owner[both][ok]] + p[ok]
        hits[to[mine[ok]]] = True
        # only classes with a member that needs its neighbours are compared
        need = np.zeros(len(members), bool)
        need[group[ok][~mine[ok]]] = True
        some = np.flatnonzero(need[group[ok]])
        if not len(some):
            continue
        at, g = begin[both][ok][some], group[ok][some]
        # whole words, which run into the blocks in common: these are equal anyway
        ahead, behind = 8 * -(-k // 8), 8 * -(-(edge - k) // 8)
        around = _words(data, at - k, ahead) + _words(data, at + depth * BLOCK + edge - k - behind, behind)
        order = np.lexsort((*around, g))
        same = g[order][1:] == g[order][:-1]
        for w in around:
            same &= w[order][1:] == w[order][:-1]
        hit = np.zeros(len(at), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        hits[to[some[hit]]] = True
    return [hits[a:b] for a, b in zip(flat[:-1].tolist(), flat[1:].tolist(), strict=True)]


def _deeper(context: bytes, place: int, size: int, window: int, level: int) -> list[tuple[int, int, int]]:
    """(lo, size, key) of the stretches of windows with one least block; blocks are told apart by bytes and by place from the key."""
    data, _, begin, _, index = _blocks([context], np.array([place]))
    h = np.full(len(begin), 0x9E3779B97F4A7C15 * (2 * level + 3) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    number = (index - place // BLOCK).astype(np.uint64)
    for word in [number, *_words(data, begin, BLOCK)]:
        h = (h ^ word) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    n = (window - BLOCK + 1) // BLOCK  # blocks that lie inside every window, counted from its first one
    first = place % BLOCK
    starts = np.arange(size)
    at = np.maximum(starts - first + BLOCK - 1, 0) // BLOCK
    least = np.lib.stride_tricks.sliding_window_view(h, n).min(axis=1)[at]
    cut = [0, *(np.flatnonzero(np.diff(least)) + 1).tolist(), size]
    return [(a, b - a, int(least[a])) for a, b in zip(cut, cut[1:], strict=False)]


def _spans(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _runs(docs: DataFrame, window: int) -> DataFrame:
    import xxhash

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out, rows = [], 0
            for k, text in zip(batch.column(0).to_numpy(), batch.column(1), strict=True):
                data = text.as_py()
                key, start, size, place = runs_of(data, window)
                if not len(key):
                    continue
                same = np.array([digest(data[a:b]) for a, b in zip(start.tolist(), (start + size + window - 1).tolist(), strict=True)], np.uint64)
                out.append((key, same, np.full(len(key), k), start, size, place))
                rows += len(key)
                if rows > 100_000:
                    yield _batch(out)
                    out, rows = [], 0
            if out:
                yield _batch(out)

    return docs.select("k", "data").mapInArrow(work, "key long, same long, k long, start long, size int, place int")


def _batch(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    key, same, k, start, size, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(same.view(np.int64)), pa.array(k), pa.array(start), pa.array(size.astype(np.int32)), pa.array(place.astype(np.int32))], ["key", "same", "k", "start", "size", "place"]
    )


def _compare(contexts: DataFrame, window: int, flush: int) -> DataFrame:
    """(key, same, lo, hi): windows lo to hi of the context are repeated. Contexts of one part are compared in one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            masks = repeated_windows([r[6] for r in rows], np.array([r[4] for r in rows]), np.array([r[5] for r in rows]), window, np.array([r[7] for r in rows]))
            got = [(r[1], r[2], r[3] + a, r[3] + b) for r, m in zip(rows, masks, strict=True) for a, b in _spans(m)]
            cols = list(zip(*got, strict=True)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["key", "same", "lo", "hi"])

        held: list[tuple] = []
        for batch in batches:
            held += list(zip(*[c.to_pylist() for c in batch.columns], strict=True))
            if len(held) >= flush:
                last = held[-1][0]
                end = len(held)
                while end and held[end - 1][0] == last:
                    end -= 1
                if end:
                    yield out(held[:end])
                    held = held[end:]
        if held:
            yield out(held)

    rows = contexts.select("part", "key", "same", "lo", "place", "size", "context", "n").repartition("part").sortWithinPartitions("part")
    return rows.mapInArrow(work, "key long, same long, lo long, hi long")


def _split(contexts: DataFrame, window: int, level: int) -> DataFrame:
    """The contexts' stretches of windows, their parts named by the next key too."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "deep", "key", "same", "lo", "place", "size", "context", "n"]
        for batch in batches:
            out = []
            for part, key, same, lo, place, size, context, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                out += [(part, deep - (1 << 64) if deep >> 63 else deep, key, same, lo + a, place - a, k, context[a : a + k + window - 1], n) for a, k, deep in _deeper(context, place, size, window, level)]
            kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names)

    each = contexts.mapInArrow(work, "part long, deep long, key long, same long, lo long, place int, size int, context binary, n long")
    return each.withColumn("part", F.xxhash64("part", "deep", F.lit(level))).drop("deep")


def repeated_spans(docs: DataFrame, scratch: Scratch, *, window: int = 200, dense: int = 20_000, levels: int = 4, flush: int = 20_000) -> DataFrame:
    """(k, spans) of the texts with repeats; docs: k, data (binary), k naming equal rows alike."""
    runs = scratch.table(_runs(docs, window))
    # counts are tables of their own: a join whose sides are plain exchanges can split a common key
    twice = scratch.table(runs.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    left = scratch.table(runs.join(twice, "key", "left_semi"))
    scratch.drop(runs)
    texts = scratch.table(left.groupBy("key", "same").agg(F.count("*").alias("n"), F.min(F.struct("k", "start", "size", "place")).alias("one")))
    asked = texts.select(F.col("one.k").alias("k"), F.struct("key", "same", "one.start", "one.size", "one.place", "n").alias("x")).groupBy("k").agg(F.collect_list("x").alias("xs"))
    found = docs.join(asked, "k").select("k", "data", F.explode("xs").alias("x")).select(
        "x.key", "x.same", "x.size", "x.place", "x.n", F.expr(f"substring(data, cast(x.start as int) + 1, x.size + {window - 1})").alias("context")
    )
    # rows that k names alike give one context each
    found = found.dropDuplicates(["key", "same"]).select(F.col("key").alias("part"), "key", "same", F.lit(0).cast("long").alias("lo"), "place", "size", "context", "n")
    found = scratch.table(found)
    for level in range(levels):
        large = scratch.table(found.groupBy("part").agg(F.count("*").alias("parts")).filter(F.col("parts") > dense).select("part"))
        if large.isEmpty():
            break
        rest = found.join(large, "part", "left_anti")
        found = scratch.table(rest.unionByName(_split(found.join(large, "part", "left_semi").select(*found.columns), window, level)))
    marks = scratch.table(_compare(found, window, flush))
    scratch.drop(found)
    hit = left.join(marks, ["key", "same"]).select("k", F.struct((F.col("start") + F.col("lo")).alias("s"), (F.col("start") + F.col("hi") + (window - 1)).alias("e")).alias("x"))
    return hit.groupBy("k").agg(F.collect_set("x").alias("spans"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans merged, and the bytes outside them."""
    kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    for batch in batches:
        sizes, spans, kept = [], [], []
        for data, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            data, out = data.as_py(), []
            for x in sorted((x["s"], x["e"]) for x in found or ()):
                if out and x[0] <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], x[1])
                else:
                    out.append(list(x))
            ends = [0, *[e for _, e in out]]
            begins = [*[b for b, _ in out], len(data)]
            sizes.append(len(data))
            spans.append([{"s": b, "e": e} for b, e in out])
            kept.append(b"".join(data[a:b] for a, b in zip(ends, begins, strict=True)) if out else data)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, *, window: int = 200, dense: int = 20_000) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (removed byte ranges, merged), kept (the bytes left).

    docs: doc_id, text; other columns aren't read. Defined results: NULL counts as
    empty, and texts under ``window`` bytes lose nothing; repeated rows are repeats
    of each other, so that both lose the text; a NULL doc_id is an id like any
    other; an empty table gives an empty result; overlapping repeats count, and
    all are judged on the input.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary"))
    rows = docs.select("doc_id", data.alias("data")).withColumn("k", F.xxhash64("doc_id", "data", F.octet_length("data")))
    spans = repeated_spans(rows.select("k", "data"), scratch, window=window, dense=dense)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.join(spans, "k", "left").select("doc_id", "data", "spans").mapInArrow(_without, f"doc_id {kind}, n_bytes long, spans array<struct<s:bigint,e:bigint>>, kept binary")
