"""Ranked lexical search by a threshold-seeded join.

The items' terms are searched for in the texts: a document's postings are the
terms it holds of those that are asked for, with their frequencies. For every term
the k greatest impacts, the scores it alone gives to documents, are stored with
their documents. They are the seeds: an item's kth score is at least the kth impact
of any of its terms, and at least the kth of the whole scores of its terms' stored
documents; the greatest of these is its threshold. Its terms, ordered by falling
greatest impact, have a suffix whose greatest impacts add up to less than the
threshold: a document that holds terms of the suffix alone can't be among the k
best, so that the suffix makes no candidates. The other terms do, and those that may
still reach the threshold are scored again, exactly, over all of the item's terms.

Items are taken in blocks of a bounded number of terms; each block is a pass over
the texts. Nothing but the block's terms, their counts and k stored impacts for
each goes to the driver.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.scratch import Scratch

#: Bytes of a text that are split at once, about.
SLICE = 4_000_000
#: Cells of documents by items, and pairs of postings and items, that are worked on at once.
CELLS = 2_000_000

_APART = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes.maketrans(_APART + string.ascii_uppercase.encode(), b" " * len(_APART) + string.ascii_lowercase.encode())
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text: Column) -> Column:
    """A text's terms, in order, with repeats; an empty array for NULL."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), F.lit(TERM), F.lit(0))


def split_terms(data: bytes) -> Iterator[list[bytes]]:
    """The same of UTF-8 bytes, slice by slice."""
    data = data.translate(_TABLE)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE) if len(data) - at > SLICE else -1
        end = end if end >= 0 else len(data)
        yield data[at:end].split()
        at = end


def _postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n, terms, tfs, row) of every document: all its terms' number, which of the given terms it holds how often, and a number of its own."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(terms)})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        get, size = shared.value.get, len(shared.value)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            lengths, sizes, found = [], [], []
            for text in batch.column(1):
                n = held = 0
                for words in split_terms(text.as_py() or b""):
                    hits = [x for x in map(get, words) if x is not None]
                    n += len(words)
                    held += len(hits)
                    found.append(np.array(hits, np.int64))
                lengths.append(n)
                sizes.append(held)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            keys, tfs = np.unique(rows * size + (np.concatenate(found) if found else np.empty(0, np.int64)), return_counts=True)
            at = pa.array(np.searchsorted(keys, np.arange(len(sizes) + 1) * size).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array((keys % max(size, 1)).astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(tfs.astype(np.int64)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists, pa.array(np.arange(row, row + batch.num_rows))], ["doc_id", "n", "terms", "tfs", "row"])
            row += batch.num_rows

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(work, f"doc_id {kind}, n long, terms array<int>, tfs array<long>, row long")


@dataclass
class Weights:
    """What a document's postings need to become impacts."""

    weight: np.ndarray
    n_docs: int
    n_terms: int

    def impacts(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, impact) of the batch's postings, by row and term."""
        lists, tfs = batch.column(2), batch.column(3).flatten().to_numpy()
        rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        t = lists.flatten().to_numpy().astype(np.int64)
        # whole numbers of any size, as a length times the number of documents may pass 64 bits
        m = np.array([50 + 50 * n * self.n_docs // self.n_terms if n else 0 for n in batch.column(1).to_pylist()], np.int64)
        return rows, t, self.weight[t] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[rows])) if len(t) else tfs


def _first_of_runs(keys: np.ndarray, k: int) -> np.ndarray:
    """Which places are among the first k of their run of equal keys."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys)))) < k


def _best_of(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """(key, value, row): the k greatest values of every key, ties by row."""
    key, value, row = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    for more in found:
        key, value, row = (np.concatenate(x) for x in zip((key, value, row), more, strict=True))
        order = np.lexsort((row, -value, key))
        order = order[_first_of_runs(key[order], k)]
        key, value, row = key[order], value[order], row[order]
    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(value), pa.array(row)], ["key", "value", "row"])


def _collected(best: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k greatest of all tasks, by key; for bounded numbers of keys."""
    by = Window.partitionBy("key").orderBy(F.desc("value"), "row")
    table = best.withColumn("at", F.row_number().over(by)).filter(F.col("at") <= k).select("key", "value", "row").toArrow()
    key, value, row = (table[c].to_numpy() for c in ("key", "value", "row"))
    order = np.lexsort((row, -value, key))
    return key[order], value[order], row[order]


def _greatest(posts: DataFrame, weights: Weights, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, impact, row): every term's k greatest impacts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in batches:
                rows, terms, impacts = weights.impacts(batch)
                yield terms, impacts, batch.column(4).to_numpy()[rows]

        return _best_of(found(), k)

    return _collected(posts.mapInArrow(work, "key long, value long, row long"), k)


def _kth(key: np.ndarray, value: np.ndarray, size: int, k: int) -> np.ndarray:
    """The kth value of every key, 0 for a key with fewer; values fall within a key."""
    ends = np.searchsorted(key, np.arange(size), side="right")
    full = np.bincount(key, minlength=size) >= k
    out = np.zeros(size, np.int64)
    out[full] = value[ends[full] - 1]
    return out


def _seeded(posts: DataFrame, weights: Weights, p: Plan, rows: np.ndarray, items: np.ndarray, k: int) -> np.ndarray:
    """The kth of the whole scores of each item's seeds, the pairs of rows (rising) and items."""
    shared = posts.sparkSession.sparkContext.broadcast((weights, p, rows, items))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, p, seeds, items = shared.value

        def found():
            for batch in batches:
                own = batch.column(4).to_numpy()
                at, place = _spread(np.searchsorted(seeds, own), np.searchsorted(seeds, own, side="right"))
                if len(at):
                    postings = weights.impacts(batch)
                    for s, e in _cuts(np.diff(p.item_at)[items[place]], CELLS):
                        yield items[place[s:e]], exact(p, at[s:e], items[place[s:e]], *postings, len(weights.weight)), own[at[s:e]]

        return _best_of(found(), k)

    key, value, _ = _collected(posts.mapInArrow(work, "key long, value long, row long"), k)
    return _kth(key, value, len(p.threshold), k)


def _cuts(cost: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches whose costs add up to about most, of one place at least."""
    total, at = np.cumsum(cost), 0
    while at < len(cost):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield at, end
        at = end


@dataclass
class Plan:
    """A block's items: all their terms, those that make candidates, and what a candidate must reach."""

    item_terms: np.ndarray  # item after item
    item_at: np.ndarray
    lead_items: np.ndarray  # term after term
    lead_at: np.ndarray
    threshold: np.ndarray
    rest: np.ndarray  # the most that the terms of the suffix add


def plan(items: list[np.ndarray], kth: np.ndarray, most: np.ndarray, seeded: np.ndarray | None = None) -> Plan:
    """items: the term numbers of each; kth, most: of the terms' impacts; seeded: what else the items' kth scores reach."""
    threshold, rest = np.zeros(len(items), np.int64) if seeded is None else seeded.copy(), np.zeros(len(items), np.int64)
    lead: list[tuple[np.ndarray, int]] = []
    for i, terms in enumerate(items):
        threshold[i] = kth[terms].max(initial=threshold[i])
        rising = terms[np.argsort(most[terms], kind="stable")]
        sums = np.cumsum(most[rising])
        left_out = int(np.searchsorted(sums, threshold[i], side="left"))  # sums below the threshold
        rest[i] = sums[left_out - 1] if left_out else 0
        lead.append((rising[left_out:], i))
    t = np.concatenate([x for x, _ in lead]) if lead else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(items)), [len(x) for x, _ in lead])
    order = np.argsort(t, kind="stable")
    item_at = np.concatenate(([0], np.cumsum([len(x) for x in items]))).astype(np.int64)
    every = np.concatenate(items) if items else np.empty(0, np.int64)
    return Plan(every, item_at, owner[order], np.searchsorted(t[order], np.arange(len(kth) + 1)), threshold, rest)


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and which place, for every place of all ranges."""
    n = end - begin
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)


def candidates(p: Plan, rows: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_rows: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, item) that hold a leading term and may reach the item's bound."""
    items = len(p.threshold)
    owner, at = _spread(p.lead_at[terms], p.lead_at[terms + 1])
    sums = np.zeros(n_rows * items, np.int64)
    np.add.at(sums, rows[owner] * items + p.lead_items[at], impacts[owner])
    sums = sums.reshape(n_rows, items)
    return np.nonzero((sums > 0) & (sums + p.rest >= bound))


def exact(p: Plan, at: np.ndarray, item: np.ndarray, rows: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int) -> np.ndarray:
    """The whole scores of (row, item); postings are ordered by row and term."""
    out = np.zeros(len(at), np.int64)
    if len(at) and len(rows):
        owner, place = _spread(p.item_at[item], p.item_at[item + 1])
        keys = rows * n_terms + terms
        asked = at[owner] * n_terms + p.item_terms[place]
        found = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        hit = keys[found] == asked
        np.add.at(out, owner[hit], impacts[found[hit]])
    return out


def _best(posts: DataFrame, ids: pa.Array, id_kind: str, p: Plan, weights: Weights, k: int) -> DataFrame:
    """(item_id, doc_id, score): of each task the k best documents of every item."""
    kind = posts.schema["doc_id"].dataType.simpleString()
    shared = posts.sparkSession.sparkContext.broadcast((p, weights, ids))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, weights, ids = shared.value
        bound = p.threshold.copy()
        held = None
        n_items = len(p.threshold)
        for batch in batches:
            rows, terms, impacts = weights.impacts(batch)
            starts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            cost = np.bincount(rows, p.lead_at[terms + 1] - p.lead_at[terms], batch.num_rows) + n_items
            for s, e in _cuts(cost, CELLS):
                own = slice(starts[s], starts[e])
                postings = rows[own] - s, terms[own], impacts[own]
                at, item = candidates(p, *postings, e - s, bound)
                whole = [exact(p, at[i:j], item[i:j], *postings, len(weights.weight)) for i, j in _cuts(np.diff(p.item_at)[item], CELLS)]
                score = np.concatenate(whole) if whole else np.empty(0, np.int64)
                good = score >= bound[item]
                if not good.any():
                    continue
                new = pa.table({"item": item[good], "score": score[good], "doc_id": batch.column(0).take(pa.array(at[good] + s))})
                held = new if held is None else pa.concat_tables([held, new])
                held = held.take(pc.sort_indices(held, sort_keys=[("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")], null_placement="at_end"))
                held = held.filter(pa.array(_first_of_runs(held["item"].to_numpy(), k))).combine_chunks()
                # an item with k documents here lets in only what is no worse than the last of them
                owners, scores = held["item"].to_numpy(), held["score"].to_numpy()
                ends = np.searchsorted(owners, np.arange(n_items), side="right")
                full = np.bincount(owners, minlength=n_items) == k
                bound[full] = np.maximum(bound[full], scores[ends[full] - 1])
        if held is not None:
            yield pa.RecordBatch.from_arrays([ids.take(held["item"].combine_chunks()), held["doc_id"].combine_chunks(), held["score"].combine_chunks()], ["item_id", "doc_id", "score"])

    return posts.mapInArrow(work, f"item_id {id_kind}, doc_id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, *, k: int = 50, block_terms: int = 50_000) -> DataFrame:
    """The k best documents of every item: item_id, rank (from 1), doc_id, score.

    docs: doc_id, text; items: item_id, text; other columns aren't read. Defined
    results: a NULL or empty text has no terms, so that such a document is never
    found and such an item finds none; rows of one item_id (NULL is one) are one
    item with the terms of all; repeated documents are found as often as they are
    there; equal scores go by doc_id, NULL last; documents that score 0 aren't
    returned; an empty table gives an empty result. A block holds about
    ``block_terms`` terms of items, or one item's; k seeds for each are broadcast.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = items.schema["item_id"].dataType
    pairs = items.select("item_id", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).distinct()
    asked = scratch.table(pairs)
    blocks = max(1, -(-asked.count() // block_terms))
    out = None
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        rows = own.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms")).orderBy("item_id").collect()  # bounded by block_terms
        terms = sorted({t for r in rows for t in r["terms"]})
        number = {t: i for i, t in enumerate(terms)}
        posts = scratch.table(_postings(docs, terms))
        total = posts.filter("n > 0").agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
        df = dict(posts.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # bounded by block_terms
        n, held = total["n"], total["l"] or 1
        weights = Weights(np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(terms))], np.int64), n, held)
        asked_terms = [np.array([number[t] for t in r["terms"]], np.int64) for r in rows]
        term, impact, row = _greatest(posts, weights, k)
        kth, most = _kth(term, impact, len(terms), k), np.zeros(len(terms), np.int64)
        np.maximum.at(most, term, impact)
        p = plan(asked_terms, np.zeros_like(kth), most)  # without a threshold all terms lead
        seed, place = _spread(p.lead_at[term], p.lead_at[term + 1])
        seeds = np.unique(np.stack((row[seed], p.lead_items[place])), axis=1)
        p = plan(asked_terms, kth, most, _seeded(posts, weights, p, *seeds, k))
        found = _best(posts, pa.array([r["item_id"] for r in rows], to_arrow_type(id_type)), id_type.simpleString(), p, weights, k)
        out = found if out is None else out.unionByName(found)
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.filter("score > 0").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
