"""Toxicity by nearest labelled examples, exact TF-IDF cosine over a block-max inverted index.

Features are words and word beginnings (four to six letters). A weight is the
usual TF-IDF times the feature's relevance, the lower confidence bound of its log
odds ratio between toxic and other examples: words that tell nothing weigh
nothing, whatever their number, and those that speak for either class stay, so
that nothing is cut by rank. The index holds labelled examples in blocks; for each
feature and block it keeps the greatest weight. A query adds these up to bound
every block, visits the blocks of the highest bounds, and then those alone that
may still hold one of its k nearest, so that the neighbours are exact. Votes
weighted by distance are calibrated on labelled examples that the index doesn't
hold.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.scratch import Scratch

from .text import words

TRIM = ".,;:!?\"'()[]{}<>*_-"


def features_of(word: str) -> list[str]:
    word = word.strip(TRIM)
    if not word:
        return []
    return [word, *[f"^{word[:n]}" for n in (4, 5, 6) if len(word) > n]]


class Known(dict):
    """The numbers of words' features, of some 500,000 words at most; a word that isn't there is looked up when it is asked for."""

    def __init__(self, number: dict[str, int]):
        super().__init__()
        self.number = number
        self.starts = {f[:4] for f in number} | {f[1:5] for f in number if f[0] == "^"}  # words that begin otherwise have no feature

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 500_000:
            self.clear()
        begins = word.strip(TRIM)[:4] in self.starts
        self[word] = out = tuple([t for t in map(self.number.get, features_of(word)) if t is not None]) if begins else ()
        return out

    def of(self, found: Iterable[str]) -> Iterator[int]:
        return chain.from_iterable(filter(None, map(self.__getitem__, found)))


@dataclass
class Index:
    """Examples as sparse unit vectors in blocks of ``block`` rows; everything is bounded by examples and features."""

    terms: dict[str, int]
    idf: np.ndarray
    ids: list
    labels: np.ndarray
    importance: np.ndarray
    pointer: np.ndarray  # (features, blocks + 1): where a feature's postings of a block begin
    rows: np.ndarray
    weights: np.ndarray
    peak: np.ndarray  # (features, blocks)
    relevance: np.ndarray
    block: int = 32
    k: int = 15
    visited: int = 0  # blocks, of all queries so far
    base: float = 0.0
    steps: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.array([0.0]), np.array([0.0])))
    known: Known = field(init=False)
    begins: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # the examples' own features and weights, row by row
    held: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    parts: np.ndarray = field(default_factory=lambda: np.empty(0))

    def __post_init__(self) -> None:
        self.known = Known(self.terms)

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers and unit TF-IDF weights of a whole text."""
        return self.weigh(Counter(self.known.of(text.lower().split())))

    def weigh(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        t = np.fromiter(sorted(counts), np.int64, len(counts))
        w = (1 + np.log(np.array([counts[x] for x in t.tolist()], float))) * self.idf[t] * self.relevance[t] if len(t) else np.empty(0)
        return t, w / np.sqrt((w * w).sum()) if len(t) else w

    def _cosines(self, blocks: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the blocks' examples with a feature in common."""
        self.visited += len(blocks)
        lo, hi = self.pointer[terms[:, None], blocks], self.pointer[terms[:, None], blocks + 1]
        n = hi - lo
        ends = np.cumsum(n).reshape(n.shape)
        at = np.repeat((lo - ends + n).ravel(), n.ravel())
        at += np.arange(len(at))
        w = np.repeat(weights, n.sum(axis=1))
        w *= self.weights[at]
        sums = np.bincount(self.rows[at], w)
        hit = np.flatnonzero(sums)
        return hit, sums[hit]

    def nearest(self, terms: np.ndarray, weights: np.ndarray, first: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest examples with a feature in common, ties by row."""
        bound = weights @ self.peak[terms]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        rows, sims = self._cosines(order[:first], terms, weights)
        least = np.partition(sims, len(sims) - self.k)[len(sims) - self.k] if len(sims) >= self.k else 0.0
        more = order[first:][bound[order[first:]] >= least - 1e-12]
        if len(more):
            others, far = self._cosines(more, terms, weights)
            rows, sims = np.concatenate((rows, others)), np.concatenate((sims, far))
        near = np.round(sims, 12)
        if len(near) > self.k:
            some = np.flatnonzero(near >= np.partition(near, len(near) - self.k)[len(near) - self.k])  # the k nearest and ties of the last
            rows, sims, near = rows[some], sims[some], near[some]
        keep = np.lexsort((rows, -near))[: self.k]
        return rows[keep], sims[keep]

    def vote(self, rows: np.ndarray, sims: np.ndarray) -> float:
        """The share of toxic examples, weighted by nearness and by how many documents an example stands for."""
        w = self.importance[rows] / (1.05 - np.minimum(sims, 1.0))
        return float((w * self.labels[rows]).sum() / w.sum())

    def shared(self, terms: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The query's features that the rows have too, those that add most to the cosines first."""
        at = np.concatenate([np.arange(self.begins[r], self.begins[r + 1]) for r in rows.tolist()]) if len(rows) else np.empty(0, np.int64)
        place = np.minimum(np.searchsorted(terms, self.held[at]), len(terms) - 1)
        same = terms[place] == self.held[at]
        added = weights * np.bincount(place[same], self.parts[at[same]], len(terms))
        order = np.argsort(-added, kind="stable")
        return terms[order[added[order] > 0]]

    def calibrated(self, vote: float) -> float:
        return float(np.interp(vote, *self.steps))


def build_index(examples: list[tuple], terms: list[str], document_counts: np.ndarray, n: int, importance: dict[int, float], relevance: np.ndarray | None = None, block: int = 32, k: int = 15) -> Index:
    """examples: (id, label, {feature: count}); rows with like features stand together, so that bounds are tight."""
    number = {t: i for i, t in enumerate(terms)}
    idf = np.log((1 + n) / (1 + document_counts)) + 1 if len(terms) else np.empty(0)
    relevance = np.ones(len(terms)) if relevance is None else relevance
    index = Index(number, idf, [], np.empty(0), np.empty(0), np.zeros((len(terms), 1), np.int64), np.empty(0, np.int64), np.empty(0), np.zeros((len(terms), 0)), relevance, block, k)
    vectors = sorted(((*index.weigh(c), label, i) for i, label, c in examples if c), key=lambda v: (int(v[0][v[1].argmax()]), v[2], str(v[3])))
    blocks = -(-len(vectors) // block)
    t = np.concatenate([v[0] for v in vectors]) if vectors else np.empty(0, np.int64)
    w = np.concatenate([v[1] for v in vectors]) if vectors else np.empty(0)
    r = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors]) if vectors else np.empty(0, np.int64)
    index.begins, index.held, index.parts = np.concatenate(([0], np.cumsum([len(v[0]) for v in vectors]))).astype(np.int64), t, w
    order = np.lexsort((r, t))
    t, w, r = t[order], w[order], r[order]
    cell = t * blocks + r // block
    index.pointer = np.searchsorted(cell, np.arange(len(terms))[:, None] * blocks + np.arange(blocks + 1)[None, :]) if blocks else index.pointer
    index.peak = np.zeros((len(terms), blocks))
    np.maximum.at(index.peak, (t, r // block), w)
    index.rows, index.weights = r, w
    index.ids = [v[3] for v in vectors]
    index.labels = np.array([v[2] for v in vectors], float)
    index.importance = np.array([importance[v[2]] for v in vectors])
    return index


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising values nearest to y, pooled: (first x of each pool, value)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for xi, yi, wi in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        if pools and pools[-1][0] == xi:
            p = pools[-1]
            p[1], p[2] = (p[1] * p[2] + yi * wi) / (p[2] + wi), p[2] + wi
        else:
            pools.append([xi, yi, wi])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            _, v, u = pools.pop()
            p = pools[-1]
            p[1], p[2] = (p[1] * p[2] + v * u) / (p[2] + u), p[2] + u
    return np.array([p[0] for p in pools]), np.array([p[1] for p in pools])


def _hashed(seed: int):
    return lambda i: F.xxhash64(F.lit(seed), F.array_join(F.slice("_w", i + 1, F.lit(5)), " "))


def _apart(texts: DataFrame, rounds: int = 3) -> DataFrame:
    """Without most near copies, whose words would look like features: of texts with equal least five-word hashes the one of the least hash, then doc_id, stays, in each round. Texts without words all stay."""
    texts = texts.withColumn("_w", words(F.lower("text"))).withColumn("_some", F.size("_w") > 0).withColumn("_x", F.xxhash64("text"))
    shingles = F.sequence(F.lit(0), F.greatest(F.size("_w") - 5, F.lit(0)))
    texts = texts.withColumns({f"_m{r}": F.array_min(F.transform(shingles, _hashed(r))) for r in range(rounds)}).drop("_w")
    for r in range(rounds):
        same = Window.partitionBy(f"_m{r}").orderBy("h", "doc_id", "_x")
        texts = texts.withColumn("_n", F.row_number().over(same)).filter((F.col("_n") == 1) | ~F.col("_some"))
    return texts.drop("_some", "_x", "_n", *[f"_m{r}" for r in range(rounds)])


def _document_counts(docs: DataFrame, terms: list[str]) -> tuple[int, np.ndarray]:
    """How many documents there are, and how many of them hold each term."""
    number = {t: i for i, t in enumerate(terms)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(number) + 1, np.int64)
        known = Known(number)
        for batch in batches:
            held[-1] += batch.num_rows
            for text in batch.column(0).to_pylist():
                found = set(known.of(set(text.lower().split()))) if text else ()
                held[list(found)] += 1
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(held[used])], ["t", "n"])

    sums = docs.select("text").mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(terms) + 1)
    for r in sums:
        out[r["t"]] = r["n"]
    return int(out[-1]), out[:-1]


def fit(docs: DataFrame, labels: DataFrame, *, sample_per_class: int = 4096, confidence: float = 3.0, k: int = 15, held_out: int = 2) -> Index:
    """An index from at most ``sample_per_class`` labelled rows of each class, those with the least hashes.

    Rows whose crc32(doc_id as text) mod 4 is ``held_out`` are never read; of the
    others every fourth, by hash, calibrates and the rest are examples. All words
    and word beginnings of the examples are features; relevance is the log odds
    ratio less ``confidence`` standard errors, and those of which that is not above
    0 weigh nothing. Document frequencies count all documents. Equal tables give
    equal indexes, however they are partitioned.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.filter("toxic is not null and doc_id is not null").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != held_out)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("h", F.xxhash64(F.lit(3), "doc_id"))
    known = scratch.table(known)
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = None
    for c in (0, 1):
        part = known.filter(F.col("toxic") == c).orderBy("h", "doc_id").limit(sample_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # bounded by sample_per_class
    texts = scratch.table(_apart(texts))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                both[label].update({f for w in set(text.as_py().lower().split()) for f in features_of(w)})
        names = list(both[0].keys() | both[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([both[0][f] for f in names], pa.int64()), pa.array([both[1][f] for f in names], pa.int64())], ["f", "n0", "n1"])

    counts = texts.select("toxic", "text").mapInArrow(count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    size = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    m0, m1 = max(size.get(0, 0), 1), max(size.get(1, 0), 1)
    odds = F.log((F.col("n1") + 0.5) / (m1 + 1)) - F.log((F.col("n0") + 0.5) / (m0 + 1))
    sure = F.abs(odds) - confidence * F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    picked = counts.withColumn("sure", sure).filter("sure > 0").orderBy("f").collect()  # words of at most 2 * sample_per_class texts
    terms = [r["f"] for r in picked]
    relevance = np.array([r["sure"] for r in picked])
    n, document_counts = _document_counts(docs, terms)
    index = build_index([], terms, document_counts, n, {0: 1.0, 1: 1.0}, relevance, k=k)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(3):
                c: Counter = Counter()
                for w in text.as_py().lower().split():
                    c.update(t for f in features_of(w) if (t := index.terms.get(f)) is not None)
                found.append(c)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([list(c) for c in found], pa.list_(pa.int64())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], ["doc_id", "toxic", "h", "t", "n"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.select("doc_id", "toxic", "h", "text").mapInArrow(vectors, f"doc_id {kind}, toxic int, h long, t array<bigint>, n array<bigint>").collect()
    rows.sort(key=lambda r: (r["h"], str(r["doc_id"]), r["toxic"], r["t"], r["n"]))
    importance = {c: total.get(c, 0) / max(1, size.get(c, 0)) for c in (0, 1)}
    examples = [(r["doc_id"], r["toxic"], dict(zip(r["t"], r["n"], strict=True))) for r in rows if r["h"] % 4]
    fitted = build_index(examples, terms, document_counts, n, importance, relevance, k=k)
    x, y, w, none = [], [], [], [0.0, 0.0]
    for r in rows:
        if r["t"]:
            if r["h"] % 4 == 0:
                at, sims = fitted.nearest(*fitted.weigh(dict(zip(r["t"], r["n"], strict=True))))
                if len(at):
                    x.append(fitted.vote(at, sims))
                    y.append(float(r["toxic"]))
                    w.append(importance[r["toxic"]])
        else:
            none[r["toxic"]] += importance[r["toxic"]]
    fitted.base = none[1] / max(sum(none), 1e-9) if sum(none) else total.get(1, 0) / max(1, sum(total.values()))
    if x:
        # one made-up half document of each class at either end keeps scores inside (0, 1)
        unit = min(importance.values()) or 1.0
        fitted.steps = isotonic(np.array([*x, min(x), max(x)]), np.array([*y, 0.0, 1.0]), np.array([*w, unit / 2, unit / 2]))
    else:
        fitted.steps = (np.array([0.0, 0.5]), np.array([0.0, 1.0]))
    return fitted


def score(docs: DataFrame, index: Index, *, held_out: int = 2, cutoff: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, neighbours (ids of the five nearest examples), evidence (the five features in common with the k nearest that add most).

    docs: doc_id, text; other columns aren't read. Defined results: NULL and empty
    texts, and texts without a feature, get the share of toxic ones among such
    examples, and no neighbours; repeated rows give repeated results; ties among
    neighbours go to the example that stands first in the index; an empty table
    gives an empty result; without labels all scores are 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        names = list(ix.terms)
        memory: dict = {}
        for batch in batches:
            values, near, why = [], [], []
            for text in batch.column(1):
                t, w = ix.vector(text.as_py() or "")
                key = (t.tobytes(), w.tobytes())
                got = memory.get(key)
                if got is None:
                    got = (ix.base, "", "")
                    if len(t):
                        rows, sims = ix.nearest(t, w)
                        if len(rows):
                            got = (ix.calibrated(ix.vote(rows, sims)), ",".join(str(ix.ids[r]) for r in rows[:5].tolist()), " ".join(names[i] for i in ix.shared(t, w, rows)[:5].tolist()))
                    if len(memory) > 100_000:
                        memory.clear()
                    memory[key] = got
                values.append(got[0])
                near.append(got[1])
                why.append(got[2])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64()), pa.array(near, pa.string()), pa.array(why, pa.string())], ["doc_id", "score", "neighbours", "evidence"])

    out = docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, score double, neighbours string, evidence string")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == held_out, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"), "neighbours", "evidence")
