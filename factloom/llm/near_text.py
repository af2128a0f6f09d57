"""Near copies by the Jaccard similarity of word shingles.

SimHash groups (fingerprints of the same shingles, compared by bit planes) hold
texts that are nearly equal; a similarity of 0.8 is some ten differing bits, which
fingerprints alone can't search for. So minimum hashes of a text's shingles, in
bands, are further keys: texts of one SimHash group or with an equal key are
candidates, and the exact similarity of their shingle sets decides. Two texts of
similarity s share a key with probability 1 - (1 - s^rows)^bands, 0.998 at 0.8.

Texts with equal sets are one. Within a key all are first compared with the one
that meets most others under all keys, which is what copies were made from, then
the members of what is still apart with each other, so that the components are
those of all candidates, while a large group of copies costs about its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.scratch import Scratch, broadcast_if_small

from .components import connected_components
from .simhash import first_of, near_duplicates


def shingles_of(text: bytes | None, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of runs of ``shingle`` words (A-Z lower-cased); a shorter text is one run, one without words has none."""
    import xxhash

    w = (text or b"").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    n = max(1, len(w) - shingle + 1)
    begin, end = np.concatenate(([0], ends[: n - 1])).tolist(), (ends[min(shingle, len(w)) - 1 :] - 1).tolist()
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(joined[a:b], 42) for a, b in zip(begin, end, strict=True)]), np.uint64))


def _marked(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, key, node, bands): key tells apart texts of one doc_id, node names the shingle set, which isn't kept."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        r = np.random.default_rng(11)
        turn, times = (r.integers(0, 1 << 64, bands * rows, np.uint64) for _ in range(2))
        times |= np.uint64(1)
        salt = np.arange(bands, dtype=np.uint64)[:, None]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                nodes, keys = [], []
                for x in part.column(2):
                    s = shingles_of(x.as_py(), shingle)
                    nodes.append(xxhash.xxh64_intdigest(s.tobytes()))
                    least = np.full(bands * rows, 0xFFFFFFFFFFFFFFFF, np.uint64)
                    for i in range(0, len(s), 4096):
                        mixed = (s[i : i + 4096, None] ^ turn) * times
                        least = np.minimum(least, (mixed ^ mixed >> np.uint64(32)).min(axis=0))
                    keys.append([xxhash.xxh64_intdigest(b.tobytes()) for b in np.hstack([salt, least.reshape(bands, rows)])] if len(s) else [])
                offsets = lambda x: pa.array(np.concatenate(([0], np.cumsum([len(y) for y in x]))), pa.int32())
                flat = np.array([k for x in keys for k in x], np.uint64).view(np.int64)
                columns = [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.ListArray.from_arrays(offsets(keys), pa.array(flat))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["doc_id", "key", "node", "bands"])

    texts = docs.select("doc_id", F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("t"))
    return texts.mapInArrow(work, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, key long, node long, bands array<bigint>")


def _sets(nodes: DataFrame, marked: DataFrame, docs: DataFrame, shingle: int, scratch: Scratch, limit: int = 1_000_000) -> DataFrame:
    """(node, s): the nodes' sets, made again from one text of each, so that no set of another text is ever written.

    The texts' keys, of 16 bytes with their nodes, are broadcast up to ``limit``;
    with more, the texts are dealt by key.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles_of(x.as_py(), shingle).view(np.int64) for x in part.column(1)]
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in sets]))), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets)))], ["node", "s"])

    asked = scratch.table(marked.select("node", "key").join(nodes.distinct(), "node").groupBy("node").agg(F.min("key").alias("key")))
    texts = docs.select(F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("t"))
    found = texts.join(broadcast_if_small(asked, asked.count(), limit), "key").groupBy("node").agg(F.first("t").alias("t"))
    return scratch.table(found.mapInArrow(work, "node long, s array<bigint>"))


def _verified(pairs: DataFrame, marked: DataFrame, docs: DataFrame, shingle: int, threshold: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are as similar."""
    pairs = scratch.table(pairs)
    sets = _sets(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), marked, docs, shingle, scratch)
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    met = met.filter(F.least(F.size("x"), F.size("y")) >= threshold * F.greatest(F.size("x"), F.size("y")))
    common = F.size(F.array_intersect("x", "y"))
    return scratch.table(met.filter(common >= threshold * (F.size("x") + F.size("y") - common)).select("a", "b"))


def similar(sets: list[np.ndarray], threshold: float, columns: int = 1 << 12) -> np.ndarray:
    """Which of the sets (sorted, distinct) are as similar to which: exact, by products of the columns that two sets have in common."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    again = times[column] > 1
    owner, column = owner[again], np.unique(column[again], return_inverse=True)[1]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        lo, hi = np.searchsorted(column, [first, first + columns])
        held = np.zeros((len(sets), min(columns, int(column[-1]) + 1 - first)), np.float32)
        held[owner[lo:hi], column[lo:hi] - first] = 1
        common += held @ held.T
    return common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-6


def _apart(members: DataFrame, marked: DataFrame, docs: DataFrame, shingle: int, threshold: float, scratch: Scratch, block: int = 1024) -> DataFrame:
    """(a, b): links between nodes of one band with different roots, one for every two roots that a task sees. members: band, node, root.

    A band's commonest root needs no comparison within itself: the other members
    are dealt to blocks of about ``block`` that meet each other and the blocks of
    the commonest root's members, every two blocks a task's.
    """
    sets = _sets(members.select("node"), marked, docs, shingle, scratch)
    roots = members.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band").agg(F.max(F.struct("n", "root")).alias("x"), F.sum("n").alias("n"))
    roots = scratch.table(roots.select("band", F.col("x.root").alias("main"), F.expr(f"(n - x.n + {block - 1}) div {block}").alias("rest"), F.expr(f"(x.n + {block - 1}) div {block}").alias("mains")))
    dealt = members.join(roots, "band").withColumn("is_main", F.col("root") == F.col("main"))
    side = F.when(F.col("is_main"), F.col("rest") + F.pmod(F.xxhash64("node"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("node"), F.col("rest")))
    last = F.when(F.col("is_main"), F.col("rest") - 1).otherwise(F.col("rest") + F.col("mains") - 1)
    dealt = dealt.filter("rest > 0").withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    dealt = dealt.select("band", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "node", "root")

    def work(table: pa.Table) -> pa.Table:
        node, root, side = (table.column(c).to_numpy() for c in ("node", "root", "side"))
        a, b = np.nonzero(np.triu(similar([x.values.to_numpy().view(np.uint64) for x in table.column("s")], threshold), 1))
        ok = root[a] != root[b]
        if table.column("lo")[0] != table.column("hi")[0]:
            ok &= side[a] != side[b]
        a, b = a[ok], b[ok]
        _, one = np.unique(np.stack([np.minimum(root[a], root[b]), np.maximum(root[a], root[b])]), axis=1, return_index=True) if len(a) else (None, np.empty(0, np.int64))
        return pa.table({"a": node[a[one]], "b": node[b[one]]})

    return dealt.join(sets, "node").groupBy("band", "lo", "hi").applyInArrow(work, "a long, b long").distinct()


def near_copies(docs: DataFrame, *, shingle: int = 5, threshold: float = 0.8, bands: int = 20, rows: int = 6, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, key (of its text), root (of its component of texts at least ``threshold`` similar)."""
    scratch = scratch or Scratch(docs.sparkSession, "near")
    marked = scratch.table(_marked(docs, shingle, bands, rows))
    dealt = marked.select("node", F.explode("bands").alias("band")).distinct()
    sizes = scratch.table(dealt.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"))
    met = scratch.table(dealt.join(sizes, "band"))
    # what copies were made from shares more keys with them than they do with each other
    known = scratch.table(met.groupBy("node").agg(F.sum("n").alias("met")))
    ranked = met.select("band", "node").join(known, "node")
    shared = scratch.table(ranked.groupBy("band").agg(F.max(F.struct("met", "node")).alias("x")).select("band", F.col("x.node").alias("b")))
    members = scratch.table(met.select("band", "node").join(shared, "band"))
    alike = near_duplicates(docs, shingle=shingle).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), F.col("root").alias("group")).distinct()
    grouped = marked.select("doc_id", "key", "node").distinct().join(alike, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k"))).select("group", "node").distinct()
    grouped = scratch.table(grouped)
    first = scratch.table(grouped.groupBy("group").agg(F.count("*").alias("n"), F.min("node").alias("b")).filter("n > 1").select("group", "b"))
    candidates = members.select("node", "b").unionByName(grouped.join(first, "group").select("node", "b"))
    links = _verified(candidates.filter("node <> b").select(F.col("node").alias("a"), "b").distinct(), marked, docs, shingle, threshold, scratch)
    roots = connected_components(links, scratch)
    now = scratch.table(members.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root")))
    mixed = scratch.table(now.groupBy("band").agg(F.count("*").alias("n"), F.min("root").alias("p"), F.max("root").alias("q")).filter("p < q").select("band", "n"))
    more = scratch.table(_apart(now.join(mixed, "band", "left_semi"), marked, docs, shingle, threshold, scratch))
    if not more.isEmpty():
        roots = connected_components(links.unionByName(more), scratch)
    return marked.select("doc_id", "key", "node").join(roots, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents' rows, all columns, one of each component: that of the smallest doc_id (NULL last), then of the least text key."""
    scratch, tables = Scratch(docs.sparkSession, "keep"), Scratch(docs.sparkSession, "near")
    found = scratch.table(near_copies(docs, scratch=tables, **options))
    tables.clear()
    return first_of(docs, found, scratch)
