"""Cross-entropy difference of documents under two matched n-gram models.

The target model counts the documents labelled good, the background model all
documents. Both are bigram models over one vocabulary, the words of all
documents, with the same smoothing, and the background's counts are scaled to the
target's number of words, as if that many of its words had been drawn: rare words
then weigh alike in both, and differences come from the domain and not from a
model's size. A document is scored by what the other documents say: its own
counts are taken out of both models first.

Words and bigrams are hashes of ``BITS`` bits. Documents are read once into chunks of
about ``CHUNK`` words. A chunk sends each of its distinct words and bigrams once,
as sorted and packed keys with counts, to the part of the key space that they are
in; a part adds up what all chunks sent and answers each chunk with the sums for
its keys. A key that all documents share is one entry per chunk, so that none is
hot, nothing is capped, and nothing but totals is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.scratch import Scratch

#: Words of a chunk, and keys of a part, about.
CHUNK, PART = 1_000_000, 2_000_000
#: Of a key; 10**13 different bigrams would give one in 7,000 the counts of another.
BITS = 56

_TEXTS = "chunk long, ids array<{}>, sizes array<int>, words binary, n_words int, tokens binary, n_tokens long"
_SENT = "part long, chunk long, n long, keys binary, counts binary"


class _Hashes(dict):
    """Hashes of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word) >> 64 - BITS
        return h


def _packed(values: np.ndarray) -> bytes:
    """An array's bytes, place by place, compressed."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return pa.compress(np.ascontiguousarray(raw), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    if not n:
        return np.empty(0, kind)
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    """Rising keys, as steps."""
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpacked(data, n, np.uint64), dtype=np.uint64)


def _pair(before: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A bigram's key; multiplied, so that it is no word's."""
    return ((before << np.uint64(21) | before >> np.uint64(BITS - 21)) ^ w) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)


def _read(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents in chunks, by _TEXTS: words are the chunk's distinct words, rising, and tokens their numbers in text order."""
    kind = docs.schema["doc_id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        hashes = _Hashes()
        ids: list = []
        sizes: list[int] = []
        flat: list[int] = []
        done = 0

        def out() -> pa.RecordBatch:
            words, tokens = np.unique(np.array(flat, np.uint64), return_inverse=True)
            columns = [pa.array([first + done]), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(ids[0].type)), pa.array([sizes], pa.list_(pa.int32()))]
            columns += [pa.array([_packed_keys(words)]), pa.array([len(words)], pa.int32()), pa.array([_packed(tokens.astype(np.uint32))]), pa.array([len(flat)])]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "ids", "sizes", "words", "n_words", "tokens", "n_tokens"])

        for batch in batches:
            taken = 0
            for i, t in enumerate(batch.column(1)):
                text = t.as_py()
                got = [hashes[x] for x in text.lower().split()] if text else []
                flat += got
                sizes.append(len(got))
                if len(flat) >= CHUNK or len(sizes) >= CHUNK:
                    ids.append(batch.column(0).slice(taken, i + 1 - taken))
                    taken = i + 1
                    yield out()
                    ids, sizes, flat, done = [], [], [], done + 1
            if taken < batch.num_rows:
                ids.append(batch.column(0).slice(taken))
        if sizes:
            yield out()

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("t"))
    return scratch.table(rows.mapInArrow(work, _TEXTS.format(kind.simpleString())))


@dataclass
class _Chunk:
    """A chunk's tokens as places among its keys."""

    sizes: np.ndarray
    keys: np.ndarray  # words and bigrams, rising
    word: np.ndarray  # for each token, the place of its word
    pair: np.ndarray  # and that of the bigram it ends; -1 for a first word
    owner: np.ndarray  # for each token, its document

    @classmethod
    def of(cls, sizes: list[int], words: bytes, n_words: int, tokens: bytes, n_tokens: int) -> _Chunk:
        size = np.array(sizes, np.int64)
        w = _unpacked_keys(words, n_words)[_unpacked(tokens, n_tokens, np.uint32)]
        begins = (np.cumsum(size) - size)[size > 0]
        inner = np.ones(n_tokens, bool)
        inner[begins] = False
        at = np.flatnonzero(inner)
        keys, place = np.unique(np.concatenate((w, _pair(w[at - 1], w[at]))), return_inverse=True)
        pair = np.full(n_tokens, -1, np.int64)
        pair[at] = place[n_tokens:]
        return cls(size, keys, place[:n_tokens], pair, np.repeat(np.arange(len(size)), size))

    def counts(self, weight: np.ndarray) -> np.ndarray:
        """For each key, the sum of its tokens' weights."""
        inner = self.pair >= 0
        return np.bincount(self.word, weight, len(self.keys)) + np.bincount(self.pair[inner], weight[inner], len(self.keys))

    def own(self, place: np.ndarray) -> np.ndarray:
        """For each token, how often its document has the key at ``place``; 0 where there is none."""
        _, inverse, times = np.unique(self.owner * (len(self.keys) + 1) + place + 1, return_inverse=True, return_counts=True)
        return np.where(place >= 0, times[inverse], 0)


def _sent(chunks: DataFrame, parts: int, counted: bool) -> DataFrame:
    """What chunks (by _TEXTS, and good: the numbers of target documents) send, by _SENT; counts of 0 if they are only to be answered."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(i << BITS) // parts for i in range(1, parts)], np.uint64)
        for batch in batches:
            for r in batch.to_pylist():
                c = _Chunk.of(r["sizes"], r["words"], r["n_words"], r["tokens"], r["n_tokens"])
                good = np.zeros(len(c.sizes))
                good[r["good"] or []] = 1
                both = [c.counts(x[c.owner]).astype(np.uint32) if counted else np.zeros(len(c.keys), np.uint32) for x in (good, np.ones(len(c.sizes)))]
                cut = [0, *np.searchsorted(c.keys, edges).tolist(), len(c.keys)]
                rows = [(p, r["chunk"], b - a, _packed_keys(c.keys[a:b]), _packed(np.concatenate([x[a:b] for x in both]))) for p, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["part", "chunk", "n", "keys", "counts"])

    return chunks.select("chunk", "sizes", "words", "n_words", "tokens", "n_tokens", "good").mapInArrow(work, _SENT)


def _answered(sent: DataFrame) -> DataFrame:
    """Sums over all chunks, for each chunk that ``asks``, in the order of its keys; n_keys: how many keys the part has."""

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys, place = np.unique(np.concatenate([_unpacked_keys(r["keys"], r["n"]) for r in rows]), return_inverse=True)
        counts = [_unpacked(r["counts"], 2 * r["n"], np.uint32).reshape(2, -1) for r in rows]
        target, every = (np.bincount(place, np.concatenate([c[i] for c in counts]), len(keys)).astype(np.uint64) for i in (0, 1))
        out, at = [], 0
        for r in rows:
            if r["asks"]:
                mine = place[at : at + r["n"]]
                out.append((r["part"], r["chunk"], r["n"], _packed(np.concatenate((target[mine], every[mine])))))
            at += r["n"]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["part", "chunk", "n", "sums"])

    return sent.groupBy("part").applyInArrow(add, "part long, chunk long, n long, sums binary")


@dataclass
class Models:
    """target_words and words: numbers of words counted; vocabulary: distinct words."""

    docs: DataFrame
    chunks: DataFrame
    parts: int
    target_words: int
    words: int
    vocabulary: int
    prior: float = 0.5
    weight: float = 2.0


def _vocabulary(chunks: DataFrame, parts: int) -> int:
    """How many distinct words all chunks have."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(i << BITS) // parts for i in range(1, parts)], np.uint64)
        for batch in batches:
            for r in batch.to_pylist():
                keys = _unpacked_keys(r["words"], r["n_words"])
                cut = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                rows = [(p, b - a, _packed_keys(keys[a:b])) for p, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]
                columns = list(zip(*rows, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "n", "keys"])

    def count(table: pa.Table) -> pa.Table:
        return pa.table({"n": [len(np.unique(np.concatenate([_unpacked_keys(r["keys"], r["n"]) for r in table.to_pylist()])))]})

    each = chunks.select("words", "n_words").mapInArrow(send, "part long, n long, keys binary").groupBy("part").applyInArrow(count, "n long")
    return each.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def fit(docs: DataFrame, labels: DataFrame) -> Models:
    """Both models, from all documents. labels: doc_id, quality (1: target). Repeated rows count each; a NULL doc_id is never a target."""
    scratch = Scratch(docs.sparkSession, "lm")
    read = _read(docs, scratch)
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    # labels grow with the documents: a merge join whatever the size
    marks = read.select("chunk", F.posexplode("ids").alias("i", "doc_id")).join(good.hint("merge"), "doc_id", "left_semi").groupBy("chunk").agg(F.collect_list("i").alias("good"))
    chunks = scratch.table(read.join(marks, "chunk", "left"))
    target = F.aggregate(F.coalesce("good", F.array().cast("array<int>")), F.lit(0).cast("long"), lambda a, i: a + F.get("sizes", i))
    n, t, distinct = chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum(target), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    scratch.drop(read)
    parts = max(1, -(-(n + distinct) // PART))
    return Models(docs, chunks, parts, t, n, _vocabulary(chunks, max(1, -(-distinct // PART))))


def _losses(c: _Chunk, sums: np.ndarray, good: np.ndarray | None, m: Models) -> list[np.ndarray]:
    """Losses of each token under the target and the background model; good: which documents the target model counts (None: neither model counts any)."""
    scale = m.target_words / max(1, m.words)
    before = np.where(c.pair >= 0, np.concatenate((np.zeros(1, np.int64), c.word[:-1]))[: len(c.word)], -1)
    places = (c.word, before, c.pair)
    mine = c.own(c.word)
    own = (mine, np.where(before >= 0, np.concatenate((np.zeros(1, np.int64), mine[:-1]))[: len(mine)], 0), c.own(c.pair))
    sizes = c.sizes[c.owner]
    out = []
    for counts, of, size, each in ((sums[0], None if good is None else good[c.owner], m.target_words, 1.0), (sums[1], None if good is None else np.ones(len(c.owner)), m.words, scale)):
        taken = np.zeros(len(c.owner)) if of is None else of
        w, b, p = (each * np.maximum(np.where(at >= 0, counts[at], 0) - taken * o, 0) for at, o in zip(places, own, strict=True))
        alone = (w + m.prior) / (each * (size - taken * sizes) + m.prior * (m.vocabulary + 1))
        out.append(-np.log((p + m.weight * alone) / (np.maximum(b, p) + m.weight)))
    return out


def score(docs: DataFrame, models: Models) -> DataFrame:
    """One row per document: doc_id, n_tokens, target_loss, background_loss (per token), score (background less target; higher is nearer the target).

    docs: doc_id, text; other columns aren't read. The documents that the models
    were fitted on are scored without their own counts, others with all counts.
    Defined results: NULL and empty texts have no tokens, NULL losses and score 0;
    repeated rows give repeated results; an empty table gives an empty result;
    without labels both models are uniform and all scores are 0; words that were
    not counted have count 0.
    """
    scratch = Scratch(docs.sparkSession, "lm-score")
    fitted = docs.sameSemantics(models.docs)
    counted = _sent(models.chunks, models.parts, True).withColumn("asks", F.lit(fitted))
    if fitted:
        chunks, sent = models.chunks, counted
    else:
        chunks = _read(docs, scratch).withColumn("good", F.lit(None).cast("array<int>"))
        sent = counted.unionByName(_sent(chunks, models.parts, False).withColumn("asks", F.lit(True)))
    answers = scratch.table(_answered(sent))
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbers = Models(None, None, models.parts, models.target_words, models.words, models.vocabulary, models.prior, models.weight)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        answered = sorted(right.to_pylist(), key=lambda r: r["part"])
        told = [_unpacked(r["sums"], 2 * r["n"], np.uint64).reshape(2, -1).astype(float) for r in answered]
        sums = np.concatenate(told, axis=1) if told else np.zeros((2, 0))
        out = []
        for i in range(left.num_rows):
            r = left.slice(i, 1).drop_columns(["ids"]).to_pylist()[0]
            ids = left.column("ids").combine_chunks()[i].values
            c = _Chunk.of(r["sizes"], r["words"], r["n_words"], r["tokens"], r["n_tokens"])
            good = np.zeros(len(c.sizes))
            good[r["good"] or []] = 1
            losses = _losses(c, sums, good if fitted else None, numbers) if r["n_tokens"] else [np.zeros(0)] * 2
            some = c.sizes > 0
            with np.errstate(invalid="ignore", divide="ignore"):
                t, b = (np.bincount(c.owner, x, len(c.sizes)) / c.sizes for x in losses)
            out.append(pa.table({"doc_id": ids, "n_tokens": c.sizes, "target_loss": pa.array(t, mask=~some), "background_loss": pa.array(b, mask=~some), "score": np.where(some, b - t, 0.0)}))
        return pa.concat_tables(out) if out else pa.table({"doc_id": pa.nulls(0, left.schema.field("ids").type.value_type), **{c: pa.array([], k) for c, k in (("n_tokens", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("score", pa.float64()))}})

    both = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return both.applyInArrow(work, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double")
