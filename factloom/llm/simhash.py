"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints have 64 bits. Two that differ in ``radius`` bits agree on at least
``blocks - radius`` of ``blocks`` blocks of bits, so that every choice of such
blocks is a key, and linked fingerprints share one. Within a key they are
compared bit-sliced: the fingerprints are stored as bit planes (one machine word
holds one bit of 64 fingerprints), the distances to a query are kept in vertical
carry-save counters that saturate above the radius, and words whose lanes have
all passed the radius are abandoned.

Copies count once (the comparison sees distinct fingerprints). A key shared by
more than ``dense`` fingerprints is refined: the same argument over its free bits
gives finer keys, which at most 2^18 fingerprints can share.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.scratch import Scratch

from .components import connected_components
from .text import field_of, rows_of

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint_of(text: bytes | None, shingle: int = 3) -> int:
    """The fingerprint of one text, as an unsigned integer."""
    import xxhash

    w = (text or b"").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    n = len(w) - shingle + 1
    digest = xxhash.xxh64_digest
    if n < 1:
        digests, n = digest(joined, 42), 1
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
        begin = np.concatenate(([0], ends[: n - 1])).tolist()
        digests = b"".join([digest(joined[a:b], 42) for a, b in zip(begin, (ends[shingle - 1 :] - 1).tolist(), strict=True)])
    counts = np.zeros(64, np.int64)
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    for i in range(0, len(rows), 1 << 16):
        counts += np.unpackbits(rows[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, key, fp): A-Z lower-cased, words between ASCII white space; NULL and texts without words have 0. key tells apart texts of one doc_id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint_of(x.as_py(), shingle) for x in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))], ["doc_id", "key", "fp"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("t"))
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key long, fp long")


def _bits(mask: int, fp: Column) -> Column:
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _masks(bits: list[int], blocks: int, radius: int) -> list[int]:
    """The key masks: all choices of blocks - radius of the blocks of these bits."""
    cut = [bits[len(bits) * i // blocks : len(bits) * (i + 1) // blocks] for i in range(blocks)]
    return [sum(1 << b for i in chosen for b in cut[i]) for chosen in combinations(range(blocks), blocks - radius)]


def keyed(distinct: DataFrame, radius: int, blocks: int, dense: int, scratch: Scratch) -> DataFrame:
    """(k1, k2, fp): rows to compare within equal (k1, k2)."""
    masks = _masks(list(range(64)), blocks, radius)
    k1 = F.array(*[F.xxhash64(F.lit(i), _bits(m, F.col("fp"))) for i, m in enumerate(masks)])
    rows = distinct.select("fp", F.posexplode(k1).alias("m", "k1"))
    heavy = scratch.table(rows.groupBy("k1").count().filter(F.col("count") > dense).select("k1"))
    zero = F.lit(0).cast("long")
    if heavy.isEmpty():
        return rows.select("k1", zero.alias("k2"), "fp")
    finer = F.lit(None).cast("array<bigint>")
    for i, m in enumerate(masks):
        free = [b for b in range(64) if not m >> b & 1]
        finer = F.when(F.col("m") == i, F.array(*[F.xxhash64(F.lit(j), _bits(x, F.col("fp"))) for j, x in enumerate(_masks(free, radius + 1, radius))])).otherwise(finer)
    light = rows.join(heavy, "k1", "left_anti").select("k1", zero.alias("k2"), "fp")
    return light.unionByName(rows.join(heavy, "k1", "left_semi").select("k1", F.explode(finer).alias("k2"), "fp"))


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(rows, 64) fingerprints to (64, rows) words: bit i of word [b, r] is bit b of fps[r, i]."""
    out = np.empty((64, len(fps)), np.uint64)
    for at in range(0, len(fps), 2048):
        part = fps[at : at + 2048]
        bits = np.unpackbits(np.ascontiguousarray(part).view(np.uint8).reshape(len(part), 64, 8), axis=2, bitorder="little")
        words = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")
        out[:, at : at + 2048] = np.ascontiguousarray(words).view(np.uint64).reshape(len(part), 64).T
    return out


def within(planes: np.ndarray, query: np.ndarray, lanes: np.ndarray, radius: int) -> np.ndarray:
    """Lanes at most ``radius`` from the query, by carry-save counters.

    planes, (64, ...) words; query, (64, ...) words of all ones or zeros; lanes,
    the lanes that count. The counter's digits are vertical words; a carry out of
    the last saturates. Words without a lane left are abandoned.
    """
    digits = max(1, int(radius).bit_length())
    shape = np.broadcast_shapes(planes.shape[1:], query.shape[1:], lanes.shape)
    size = int(np.prod(shape))
    p = np.broadcast_to(planes, (64, *shape)).reshape(64, size)
    q = np.broadcast_to(query, (64, *shape)).reshape(64, size)
    left = np.array(np.broadcast_to(lanes, shape)).reshape(size)
    out, where = np.zeros(size, np.uint64), np.arange(size)
    count = [np.zeros(size, np.uint64) for _ in range(digits)]
    over = np.zeros(size, np.uint64)

    def far() -> np.ndarray:
        # counts above the radius: compare the digits with the radius from the top
        more, same = over.copy(), ~over
        for d in reversed(range(digits)):
            if radius >> d & 1:
                same &= count[d]
            else:
                more |= same & count[d]
                same &= ~count[d]
        return more

    for b in range(64):
        carry = p[b] ^ q[b]
        for d in range(digits):
            count[d], carry = count[d] ^ carry, count[d] & carry
        over |= carry
        if b % 8 == 7:
            left = left & ~far()
            alive = left != 0
            n = int(alive.sum())
            if not n:
                return out.reshape(shape)
            if b < 63 and n < len(left) // 2:
                p, q, left, over, where = p[:, alive], q[:, alive], left[alive], over[alive], where[alive]
                count = [c[alive] for c in count]
    out[where] = left
    return out.reshape(shape)


def _spread(bits: np.ndarray) -> np.ndarray:
    """Bit j of words, as words of all ones or zeros."""
    return (~bits.astype(np.uint64)) + np.uint64(1)


def _settle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least label in each component of n nodes with links a-b."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _small_runs(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of 2 to 64: one word each, many runs at once."""
    order = np.argsort(-sizes, kind="stable")
    for at in range(0, len(order), 8192):
        o = order[at : at + 8192]
        s, n = starts[o], sizes[o]
        grid = s[:, None] + np.minimum(np.arange(64)[None, :], n[:, None] - 1)
        planes = planes_of(fps[grid])
        valid = np.where(n == 64, ONES, (np.uint64(1) << n.astype(np.uint64) % np.uint64(64)) - np.uint64(1))
        found = []
        for j in range(int(n[0]) - 1):
            m = int((n > j + 1).sum())
            lanes = valid[:m] & ~np.uint64((1 << (j + 1)) - 1)
            hit = within(planes[:, :m], _spread(planes[:, :m] >> np.uint64(j) & np.uint64(1)), lanes, radius)
            rows = np.nonzero(hit)[0]
            if len(rows):
                bits = np.unpackbits(hit[rows].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                r, i = np.nonzero(bits)
                found.append((s[rows[r]] + j, s[rows[r]] + i))
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            nodes, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
            label = _settle(len(nodes), inverse[: len(a)], inverse[len(a) :])
            keep = label != np.arange(len(nodes))
            yield fps[nodes[keep]], fps[nodes[label[keep]]]


def _large_run(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A run of over 64: breadth-first, queries by 64; each fingerprint is reached once, so links stay as many as fingerprints."""
    n = len(fps)
    words = -(-n // 64)
    planes = planes_of(np.concatenate((fps, np.full(words * 64 - n, fps[-1]))).reshape(words, 64))
    open_ = np.full(words, ONES)
    if n % 64:
        open_[-1] = np.uint64((1 << (n % 64)) - 1)
    a, b = [], []

    def ask(ids: np.ndarray) -> np.ndarray:
        query = _spread(fps[ids][None, :] >> np.arange(64, dtype=np.uint64)[:, None] & np.uint64(1))
        busy = np.nonzero(open_)[0]
        out = np.zeros((len(ids), words), np.uint64)
        if len(busy):
            out[:, busy] = within(planes[:, None, busy], query[:, :, None], open_[None, busy], radius)
        return out

    def reach(hit: np.ndarray, i: int) -> list[int]:
        new = hit & open_
        rows = np.nonzero(new)[0]
        if not len(rows):
            return []
        r, k = np.nonzero(np.unpackbits(new[rows].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        ids = rows[r] * 64 + k
        open_[rows] &= ~new[rows]
        a.append(np.full(len(ids), i))
        b.append(ids)
        return ids.tolist()

    for at in range(0, n, 64):
        seeds = np.arange(at, min(at + 64, n))
        seeds = seeds[(open_[at // 64] >> (seeds - at).astype(np.uint64) & np.uint64(1)).astype(bool)]
        if not len(seeds):
            continue
        first = ask(seeds)
        for i, hit in zip(seeds.tolist(), first, strict=True):
            if not open_[i // 64] >> np.uint64(i % 64) & np.uint64(1):
                continue
            open_[i // 64] &= ~(np.uint64(1) << np.uint64(i % 64))
            queue = reach(hit, i)
            while queue:
                batch, queue = queue[:64], queue[64:]
                for k, h in zip(batch, ask(np.array(batch)), strict=True):
                    queue += reach(h, k)
    if not a:
        return fps[:0], fps[:0]
    return fps[np.concatenate(a)], fps[np.concatenate(b)]


def links_in_runs(keys: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span the components of each run of equal keys."""
    cut = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1 if len(keys) else np.empty(0, np.int64)
    starts = np.concatenate(([0], cut)).astype(np.int64)
    sizes = np.diff(np.concatenate((starts, [len(fps)])))
    small = (sizes > 1) & (sizes <= 64)
    if small.any():
        yield from _small_runs(fps, starts[small], sizes[small], radius)
    for s, n in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
        yield _large_run(fps[s : s + n], radius)


def links(distinct: DataFrame, scratch: Scratch, *, radius: int = 2, blocks: int = 5, dense: int = 20_000, flush: int = 200_000) -> DataFrame:
    """(a, b) between distinct fingerprints; they span exactly the components of all pairs within the radius."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys, fps):
            for a, b in links_in_runs(keys, fps, radius):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        keys, fps = np.empty((0, 2), np.int64), np.empty(0, np.uint64)
        held, rows = [], 0
        for batch in batches:
            held.append((np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1), batch.column(2).to_numpy().view(np.uint64)))
            rows += batch.num_rows
            if rows < flush:
                continue
            keys, fps = np.concatenate([keys, *[h[0] for h in held]]), np.concatenate([fps, *[h[1] for h in held]])
            held, rows = [], 0
            # the last run may go on in the next batch
            done = np.flatnonzero(np.any(keys != keys[-1], axis=1))
            end = int(done[-1]) + 1 if len(done) else 0
            yield from out(keys[:end], fps[:end])
            keys, fps = keys[end:], fps[end:]
        keys, fps = np.concatenate([keys, *[h[0] for h in held]]), np.concatenate([fps, *[h[1] for h in held]])
        yield from out(keys, fps)

    rows = keyed(distinct, radius, blocks, dense, scratch)
    dealt = rows.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "fp")
    return dealt.mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, *, radius: int = 2, shingle: int = 3, blocks: int = 5, dense: int = 20_000) -> DataFrame:
    """One row per document: doc_id, key (of its text), fp (long), root (of its component), component_id (smallest doc_id that links reach).

    docs: doc_id, text; other columns aren't read. Defined results: NULL and empty
    texts have fingerprint 0 and are linked like any other; repeated rows give
    repeated results; a NULL doc_id takes part but is never a component's
    smallest, unless all are NULL; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.table(fingerprints(docs, shingle))
    distinct = scratch.table(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(distinct.select("fp"), scratch, radius=radius, blocks=blocks, dense=dense), scratch)
    tied = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    of = tied.select("fp", "root").join(least, "root")
    return marked.join(of, "fp").select("doc_id", "key", "fp", "root", "component_id")


def first_of(docs: DataFrame, marked: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents' rows, all columns, one of each root: that of the smallest doc_id (NULL last), then of the least text key; of rows with one doc_id and text any stays, whatever its other columns. marked: a table of doc_id, key, root."""
    first = marked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key")).alias("x"))
    heads = scratch.table(first.select(F.col("x.doc_id").alias("_d"), F.col("x.key").alias("_k")))
    again = marked.groupBy("doc_id", "key").count().filter("count > 1").isEmpty()
    scratch.drop(marked)
    rows = rows_of(docs).select("row", field_of("doc_id").alias("d"), F.xxhash64(field_of("text")).alias("key"))
    kept = rows.join(heads, F.col("d").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left_semi")
    return (kept if again else kept.dropDuplicates(["d", "key"])).select("row.*")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents' rows, all columns, one of each component: that of the smallest doc_id (NULL last), then of the least text key."""
    scratch = Scratch(docs.sparkSession, "keep")
    return first_of(docs, scratch.table(near_duplicates(docs, **options).select("doc_id", "key", "root")), scratch)


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
