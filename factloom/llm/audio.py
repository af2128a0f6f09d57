"""Chroma fingerprints of recordings, and their alignment.

Samples become frames of twelve pitch-class energies. Over the integral image of
these frames, rectangle filters compare neighbouring areas; each answer is
quantised to two bits in Gray code, and sixteen answers make a packed 32-bit
integer per frame. Recordings are compared by the share of differing bits
at their best offset. Keys of sampled bits of two prints make offset histograms:
recordings that share a key at two places have a vote for the offset between
these, and every offset with a vote is compared in full.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.scratch import Scratch
from factloom.workers import importable

#: kind, first pitch class, height, width in frames; kinds: 0 level, 1 top against bottom, 2 early against late, 3 crossed, 4 middle pitch against rest, 5 middle time against rest.
FILTERS = tuple((k, y, h, w) for (k, h, w) in ((1, 4, 8), (2, 3, 8), (3, 4, 8), (5, 4, 9), (4, 6, 6)) for y in (0, 3, 6))[:15] + ((0, 0, 6, 8),)
WIDTH = max(w for *_, w in FILTERS)
EDGES = (-0.12, 0.0, 0.12)
GRAY = np.array([0, 1, 3, 2], np.uint32)


def chroma(samples: np.ndarray, rate: int, frame: int = 1024, hop: int = 256, low: float = 60.0, high: float = 1800.0) -> np.ndarray:
    """(frames, 12) energies by pitch class, each frame of unit sum; silence is uniform."""
    n = 1 + (len(samples) - frame) // hop if len(samples) >= frame else 0
    if n <= 0:
        return np.zeros((0, 12))
    cut = np.lib.stride_tricks.sliding_window_view(samples, frame)[::hop][:n]
    power = np.abs(np.fft.rfft(cut * np.hanning(frame), axis=1)) ** 2
    hz = np.fft.rfftfreq(frame, 1 / rate)
    used = (hz >= low) & (hz <= high)
    pitch = np.round(12 * np.log2(hz[used] / 440.0)).astype(int) % 12
    out = power[:, used] @ np.eye(12)[pitch]
    total = out.sum(axis=1, keepdims=True)
    return np.where(total > 1e-9, out / np.maximum(total, 1e-9), 1 / 12)


def packed(frames: np.ndarray) -> np.ndarray:
    """One unsigned 32-bit integer for every stretch of WIDTH frames."""
    n = len(frames) - WIDTH + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    table = np.zeros((len(frames) + 1, 13))
    table[1:, 1:] = frames.cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return table[t + t1, y1] - table[t + t0, y1] - table[t + t1, y0] + table[t + t0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        a, b, m, u, v = y, y + h, y + h // 2, w // 2, w // 3
        if kind == 0:
            one, two = area(0, w, a, b), area(0, w, b, min(12, b + h))
        elif kind == 1:
            one, two = area(0, w, a, m), area(0, w, m, b)
        elif kind == 2:
            one, two = area(0, u, a, b), area(u, w, a, b)
        elif kind == 3:
            one, two = area(0, u, a, m) + area(u, w, m, b), area(0, u, m, b) + area(u, w, a, m)
        elif kind == 4:
            one, two = 2 * area(0, w, a + h // 3, b - h // 3), area(0, w, a, a + h // 3) + area(0, w, b - h // 3, b)
        else:
            one, two = 2 * area(v, w - v, a, b), area(0, v, a, b) + area(w - v, w, a, b)
        answer = np.log((1e-3 + one) / (1e-3 + two))
        out = out << np.uint32(2) | GRAY[np.digitize(answer, EDGES)]
    return out


def fingerprint_column(media: DataFrame, decode: Callable[[object], tuple[np.ndarray, int]]) -> DataFrame:
    """(rec_id, prints): media has rec_id and media, whatever ``decode`` turns into samples and their rate; NULL has no prints."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1).to_pylist():
                rows.append([] if x is None else packed(chroma(*decode(x))).astype(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["rec_id", "prints"])

    importable(media.sparkSession)
    kind = media.schema["rec_id"].dataType.simpleString()
    return media.select("rec_id", "media").mapInArrow(work, f"rec_id {kind}, prints array<bigint>")


def pcm16(raw: bytes, rate: int = 4000) -> tuple[np.ndarray, int]:
    """Little-endian 16-bit mono samples."""
    return np.frombuffer(raw[: len(raw) // 2 * 2], "<i2") / 32768.0, rate


#: The print of silence, of which two equal ones are no evidence.
SILENT = packed(np.full((WIDTH, 12), 1 / 12))[0]
#: A key is made of as many bits of a print and of the print so far behind it, another choice of bits for each table.
TABLES, KEY_BITS, BEHIND = 32, 16, 8
#: Prints whose bits are summed in the bound that rules out pairs.
SEGMENT = 2


def _keys(prints: np.ndarray) -> np.ndarray:
    """(tables, rows, places): keys of all places; those of silence are the rows' own, so that they meet none."""
    n = prints.shape[1] - BEHIND
    r = np.random.default_rng(5)
    here, there = prints[:, :n], prints[:, BEHIND:]
    out = np.empty((TABLES, len(prints), n), np.int64)
    for k in range(TABLES):
        out[k] = k
        for source in (here, there):
            for bit in r.permutation(32)[:KEY_BITS].tolist():
                out[k] = out[k] << 1 | (source >> np.uint32(bit) & np.uint32(1))
    out[:, (here == SILENT) & (there == SILENT)] = -1
    return out


def _voted(a: np.ndarray, b: np.ndarray, min_overlap: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(row of a, row of b, offset) of all entries of the offset histograms of all pairs; None if there are over ``most`` votes.

    Every key that two rows share at places t and u is a vote for the offset u - t.
    """
    x, y = a.shape[1], b.shape[1]
    span = x + y
    seen = []
    for one, two in zip(_keys(a), _keys(b), strict=True):
        order = np.argsort(two.ravel(), kind="stable")
        held = two.ravel()[order]
        asked = one.ravel()
        lo, hi = np.searchsorted(held, asked, "left"), np.searchsorted(held, asked, "right")
        n = np.where(asked < 0, 0, hi - lo)
        most -= int(n.sum())
        if most < 0:
            return None
        at = np.repeat(np.arange(len(asked)), n)
        hit = order[np.repeat(lo, n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)]
        (p, t), (q, u) = np.divmod(at, one.shape[1]), np.divmod(hit, two.shape[1])
        offset = u - t
        far = np.minimum(x, y - offset) - np.maximum(0, -offset) >= min_overlap
        seen.append(np.unique((p[far] * len(b) + q[far]) * span + offset[far] + x))
    pairs, offset = np.divmod(np.unique(np.concatenate(seen)), span)
    return *np.divmod(pairs, len(b)), offset - x


def _bounds(bits: np.ndarray, begin: int, n: int) -> np.ndarray:
    """Rows' sums over stretches of SEGMENT prints, n prints from ``begin``, scaled to an orthonormal projection; bits are running sums (rows, prints + 1, 32)."""
    cut = np.append(np.arange(0, n, SEGMENT), n)
    sums = np.diff(bits[:, begin + cut], axis=1) / np.sqrt(np.diff(cut), dtype=np.float32)[None, :, None]
    return sums.reshape(len(bits), -1)


def _sums(prints: np.ndarray) -> np.ndarray:
    out = np.zeros((len(prints), prints.shape[1] + 1, 32), np.float32)
    bits = np.unpackbits(np.ascontiguousarray(prints, "<u4").view(np.uint8).reshape(*prints.shape, 4), axis=2)
    np.cumsum(bits, axis=1, dtype=np.float32, out=out[:, 1:])
    return out


def _possible(a: np.ndarray, b: np.ndarray, max_error: float, min_overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(rows of a, rows of b, offset) of all that can be as near, by offset.

    Differing bits are a squared distance, which no projection makes greater: the
    distance of sums over few prints, a matrix product, rules out most pairs.
    """
    x, y = a.shape[1], b.shape[1]
    sa, sb = _sums(a), _sums(b)
    for offset in range(min_overlap - x, y - min_overlap + 1):
        lo, hi = max(0, -offset), min(x, y - offset)
        n = hi - lo
        if n < max(1, min_overlap):
            continue
        one, two = _bounds(sa, lo, n), _bounds(sb, lo + offset, n)
        # |u - v|^2 as one product: the squares ride along as two columns
        one = np.hstack([one, np.ones((len(one), 1), np.float32), (one * one).sum(axis=1, keepdims=True)])
        two = np.hstack([-2 * two, (two * two).sum(axis=1, keepdims=True), np.ones((len(two), 1), np.float32)])
        yield *np.divmod(np.flatnonzero(one @ two.T <= 32.0 * n * max_error * (1 + 1e-4) + 0.5), len(b)), offset


def closest(a: np.ndarray, b: np.ndarray, max_error: float, min_overlap: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, offset, error) of two rows with an offset of at most ``max_error`` differing bits over ``min_overlap`` prints or more that aren't silent in both, at the offset of the least error, then the nearest to 0, then the greatest.

    Rows are prints of one length each, uint32. Every offset with a vote is
    compared bit by bit. ``exact``, and rows that share so many keys that votes
    would cost more, are compared at all offsets that a bound can't rule out.
    """
    x, y = a.shape[1], b.shape[1]
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if min(x, y) < max(1, min_overlap):
        return none
    voted = None if exact or min(x, y) <= BEHIND else _voted(a, b, min_overlap, 1_000_000 + len(a) * len(b) * (x + y) // 4)
    if voted is None:
        some = _possible(a, b, max_error, min_overlap)
    else:
        order = np.argsort(voted[2], kind="stable")
        rows, others, offsets = (v[order] for v in voted)
        cut = [0, *(np.flatnonzero(np.diff(offsets)) + 1).tolist(), len(offsets)]
        some = ((rows[i:j], others[i:j], int(offsets[i])) for i, j in zip(cut, cut[1:], strict=False) if j > i)
    found = []
    for i, j, offset in some:
        lo, hi = max(0, -offset), min(x, y - offset)
        for at in range(0, len(i), 1 << 15):
            p, q = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
            one, two = a[p, lo:hi], b[q, lo + offset : hi + offset]
            n = hi - lo - ((one == SILENT) & (two == SILENT)).sum(axis=1)
            error = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64) / (32.0 * np.maximum(n, 1))
            near = (error <= max_error) & (n >= min_overlap)
            if near.any():
                found.append((p[near], q[near], np.full(int(near.sum()), offset), error[near]))
    if not found:
        return none
    p, q, offset, error = (np.concatenate(f) for f in zip(*found, strict=True))
    order = np.lexsort((-offset, np.abs(offset), error, q, p))
    p, q, offset, error = p[order], q[order], offset[order], error[order]
    first = np.concatenate(([True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])))
    return p[first], q[first], offset[first], error[first]


def _by_length(rows: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, prints) of a block's rows, those of one length together."""
    keys, prints = rows.field("key").to_numpy(), rows.field("prints")
    sizes = prints.value_lengths().to_numpy()
    flat, starts = prints.flatten().to_numpy().astype(np.uint32), np.concatenate(([0], np.cumsum(sizes)))[:-1]
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        yield keys[at], flat[starts[at][:, None] + np.arange(n)[None, :]]


def _links(asked: DataFrame, classes: DataFrame, max_error: float, min_overlap: int, block: int) -> DataFrame:
    """(q, r, offset, error): every query with every class that aligns, by blocks of about ``block`` prints of queries and of classes.

    Both tables: key, prints. Blocks meet by their numbers; none depends on what
    its rows hold, so that no key is hot.
    """
    prints = [t.agg(F.coalesce(F.sum(F.size("prints")), F.lit(0))).first()[0] for t in (asked, classes)]
    n, m = (-(-p // block) or 1 for p in prints)

    def blocks(rows: DataFrame, count: int, name: str, others: int, meets: str) -> DataFrame:
        held = rows.groupBy(F.pmod("key", F.lit(count)).alias(f"{name}_at")).agg(F.collect_list(F.struct("key", "prints")).alias(name))
        return held.withColumn(f"{meets}_at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for q_keys, a in _by_length(batch.column(0)[i].values):
                    for r_keys, b in _by_length(batch.column(1)[i].values):
                        p, q, offset, error = closest(a, b, max_error, min_overlap)
                        yield pa.RecordBatch.from_arrays([pa.array(q_keys[p]), pa.array(r_keys[q]), pa.array(offset.astype(np.int32)), pa.array(error)], ["q", "r", "offset", "error"])

    pairs = blocks(asked, n, "a", m, "b").hint("merge").join(blocks(classes, m, "b", n, "a"), ["a_at", "b_at"])
    return pairs.select("a", "b").mapInArrow(work, "q long, r long, offset int, error double")


def align(prints: DataFrame, queries: DataFrame, *, max_error: float = 0.15, min_overlap: int = 20, block: int = 100_000) -> DataFrame:
    """One row per recording: rec_id, class_id, n_prints, n_links, best_match, best_offset, best_error.

    Both tables: rec_id, prints; a query is what is asked for the recording of its
    rec_id, the recording itself or a clip of it. Recordings with equal prints form
    a class, named by its least rec_id, so that copies are compared once. n_links
    counts the classes that align with a query at no more than ``max_error``
    differing bits over ``min_overlap`` prints or more, the query's own among them
    if it does; the best of them is given with the offset of the least error. It is
    NULL for recordings without a query. Defined results: prints that are silent
    on both sides are no evidence; NULL or short recordings have no prints and no
    links; repeated rows give repeated results, and repeated queries of one rec_id
    count together; a query without rec_id is none; an empty table gives an empty
    result; ties for the best match go to the least class.
    """
    scratch = Scratch(prints.sparkSession, "audio")
    held = scratch.table(prints.select("rec_id", "prints").withColumn("key", F.xxhash64("prints")))
    classes = scratch.table(held.filter(F.size("prints") > 0).groupBy("key").agg(F.min("rec_id").alias("class_id"), F.first("prints").alias("prints")))
    asks = queries.select("rec_id", F.coalesce("prints", F.array().cast("array<bigint>")).alias("prints")).filter("rec_id is not null").distinct()
    asks = scratch.table(asks.withColumn("key", F.xxhash64("rec_id", "prints")))
    names = classes.select(F.col("key").alias("r"), F.col("class_id").alias("r_id"))
    links = _links(asks.filter(F.size("prints") > 0).select("key", "prints"), classes.select("key", "prints"), max_error, min_overlap, block)
    pairs = scratch.table(links).join(names, "r").join(asks.select(F.col("key").alias("q"), "rec_id"), "q")
    best = pairs.groupBy("rec_id", "r").agg(F.min(F.struct("error", "r_id", F.abs("offset"), -F.col("offset"), "offset")).alias("b"))
    found = asks.select("rec_id").distinct().join(best.groupBy("rec_id").agg(F.count("*").alias("n"), F.min("b").alias("b")), "rec_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    out = held.join(classes.select("key", "class_id"), "key", "left").join(found, "rec_id", "left")
    return out.select(
        "rec_id", F.coalesce("class_id", "rec_id").alias("class_id"), F.greatest(F.size("prints"), F.lit(0)).cast("long").alias("n_prints"), F.col("n").alias("n_links"),
        F.col("b.r_id").alias("best_match"), F.col("b.offset").alias("best_offset"), F.col("b.error").alias("best_error"),
    )


def render_vector(notes: int = 32, rate: int = 4000, seconds: float = 0.125, noise: float = 0.0, part: float = 1.0) -> Callable[[object], tuple[np.ndarray, int]]:
    """A decoder for tables without audio: a vector as a row of chords, near vectors as near recordings.

    A clip is a ``part`` of it, from a place that follows from the vector, with
    white noise of ``noise`` times its deviation.
    """
    n = int(rate * seconds)
    tones = np.sin(2 * np.pi * 220 * 2 ** (np.arange(12)[:, None] / 12) * np.arange(n)[None, :] / rate)
    mixers: dict[int, np.ndarray] = {}

    def decode(vector: object) -> tuple[np.ndarray, int]:
        v = np.nan_to_num(np.array([0.0 if x is None else x for x in vector], float))
        if not len(v):
            return np.zeros(0), rate
        k = max(1, -(-len(v) // notes))
        v = np.concatenate((v, np.zeros(k * notes - len(v)))).reshape(notes, k)
        if k not in mixers:
            mixers[k] = np.random.default_rng(7 + k).normal(size=(k, 12))
        level = v / max(np.abs(v).max(), 1e-9) @ mixers[k]
        level = np.exp(2.0 * level / np.sqrt(k))
        out = (level / level.sum(axis=1, keepdims=True) @ tones).ravel()
        if noise or part < 1:
            r = np.random.default_rng(zlib.crc32(v.tobytes()))
            size = int(len(out) * part)
            begin = int(r.integers(0, len(out) - size + 1))
            out = out[begin : begin + size]
            out = out + noise * out.std() * r.normal(size=size)
        return out, rate

    return decode
