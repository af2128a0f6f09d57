"""Quality scores from random-indexing word vectors and a small network.

Every word has an index vector, a few entries of +1 and -1 that follow from its
hash. The context vector of a vocabulary word is the sum of the index vectors of its
neighbours, over all documents: words used alike get like vectors. The vocabulary
is the words of the labelled sample that enough of its documents hold; a word
outside it is taken as its shape (letters, digits, marks, how long), and shapes are
vocabulary words too. A word's vector is its context vector, centred and of length
one, beside its index vector. A document is pooled: the mean over its words, the
mean over its different words, how many there are, how many differ and how often
one is drawn or follows twice. Texts are split and their words numbered some thousands
at a time, by Arrow: a word is looked up once for all its places among them. A network
with one hidden layer, in numpy, learns from the sample; a temperature, fitted to
labelled rows that the network hasn't seen, makes its outputs probabilities.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.scratch import Scratch

WORDS, SPACE, NOT_WORD = re.compile(r"\w+|[^\w\s]"), re.compile(r"\s"), re.compile(r"[^\w ]")
#: Bytes that are no marks; the others are looked at one by one.
PLAIN = b"abcdefghijklmnopqrstuvwxyz0123456789_ "
#: Entries of an index vector that aren't 0; neighbours on either side; characters of a text that are split at once, and of texts that are numbered at once.
ENTRIES, REACH, SLICE, BUNCH = 4, 2, 1_000_000, 8_000_000


def shape(word: str) -> str:
    """What is said of a word outside the vocabulary; no word has a blank."""
    kind = "letters" if word.isalpha() else "digits" if word.isdigit() else "mixed" if word[0].isalnum() else "mark"
    return f"{kind} {min(len(word), 12) if len(word) <= 30 else 30}"


def word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 12)


def index_entries(word: str, size: int) -> tuple[list[int], list[int]]:
    """Where a word's index vector isn't 0, and what it is there; from its hash alone."""
    h = word_hash(word)
    return [(h >> 12 * i) % size for i in range(ENTRIES)], [1 if h >> 48 + i & 1 else -1 for i in range(ENTRIES)]


def index_vectors(hashes: Iterable[int], size: int) -> np.ndarray:
    """The index vectors of words with these hashes, as rows; entries that meet in one place add up."""
    h = np.array(hashes, np.uint64)
    out, rows = np.zeros((len(h), size), np.int8), np.arange(len(h))
    for i in range(ENTRIES):
        out[rows, ((h >> np.uint64(12 * i)) % np.uint64(size)).astype(np.int64)] += ((h >> np.uint64(48 + i) & np.uint64(1)).astype(np.int8) * 2 - 1).astype(np.int8)
    return out


class _Known(dict):
    """Numbers of the words met, from 0: the vocabulary, its shapes first, then the others as they come. ``as_known`` has the vocabulary number that stands for each, ``places`` the hash that its index vector follows from."""

    def __init__(self, vocabulary: list[str], size: int):
        self.clear()
        self.update({w: i for i, w in enumerate(vocabulary)})
        self.vocabulary, self.size = vocabulary, size
        self.as_known, self.places = array("q", range(len(vocabulary))), array("Q", map(word_hash, vocabulary))

    def meet(self, words: list[str]) -> np.ndarray:
        """The numbers of words that all differ."""
        new = [w for w in words if w not in self]
        self.places.extend(map(word_hash, new))
        self.as_known.extend([self.get(shape(w), 0) for w in new])
        self.update(zip(new, range(len(self), len(self) + len(new)), strict=True))
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def trim(self, most: int = 300_000) -> None:
        if len(self) > most:
            self.__init__(self.vocabulary, self.size)


def spaced(text: str) -> Iterator[str]:
    """A whole text in lower case with blanks between its words and no other white space, slice by slice, cut between words."""
    text = text.lower()
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > SLICE:
            gap = SPACE.search(text, at + SLICE)
            end = gap.start() if gap else end
        part, at = text[at:end], end
        rest = part.encode("utf-8", "surrogatepass").translate(None, PLAIN).decode("utf-8", "surrogatepass")
        marks = list(filter(NOT_WORD.match, set(rest)))
        if len(marks) > 200:  # each costs a pass over the slice
            part = " ".join(WORDS.findall(part))
        else:
            for m in marks:
                part = part.replace(m, " " if m.isspace() else f" {m} ")
        yield part


def numbered_all(texts: list[str], known: _Known) -> tuple[np.ndarray, np.ndarray]:
    """The words of whole texts as numbers, one text after the other, and how many words each text has."""
    out, lengths = [], np.zeros(len(texts), np.int64)
    parts, owners, n = [], [], 0

    def work() -> None:
        split = pc.split_pattern(pa.array(parts, pa.large_string()), " ")
        words = split.flatten().dictionary_encode()
        different, codes = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        nothing = different.index("") if "" in different else len(different)  # what is between two blanks in a row
        real = codes != nothing
        before = np.append(0, np.cumsum(real))[split.offsets.to_numpy()]
        np.add.at(lengths, owners, np.diff(before))
        codes = codes[real]
        out.append(known.meet(different[:nothing] + different[nothing + 1 :])[codes - (codes > nothing)])
        parts.clear()
        owners.clear()

    for i, text in enumerate(texts):
        for part in spaced(text):
            parts.append(part)
            owners.append(i)
            n += len(part)
            if n >= BUNCH:
                work()
                n = 0
    if parts:
        work()
    return np.concatenate(out) if out else np.empty(0, np.int64), lengths


def numbered(text: str, known: _Known) -> np.ndarray:
    """The words of a whole text as numbers."""
    return numbered_all([text], known)[0]


def bunches(texts: pa.Array) -> Iterator[list[str]]:
    """Whole texts, NULL as empty, some thousands at a time; a long one alone."""
    held, n = [], 0
    for text in texts:
        held.append(text.as_py() or "")
        n += len(held[-1])
        if n >= BUNCH:
            yield held
            held, n = [], 0
    if held:
        yield held


@dataclass
class Model:
    vocabulary: list[str]
    size: int
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((1, 1), np.float32))  # a row for each vocabulary word
    mean: np.ndarray = field(default_factory=lambda: np.zeros(1))
    scale: np.ndarray = field(default_factory=lambda: np.ones(1))
    layers: list[np.ndarray] = field(default_factory=list)  # weights and offsets of the hidden layer, then of the output
    temperature: float = 1.0
    base: float = 0.5  # of texts without a word, and of all if there was nothing to learn

    def pooled(self, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """A row of features for each document; words: vocabulary numbers, one document after the other."""
        width, most = self.vectors.shape[1], len(self.vectors)
        out = np.zeros((len(lengths), 2 * width + 5), np.float32)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        pairs = np.sort(owner * most + words)
        first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.empty(0, np.int64)
        n, of, different = np.diff(np.append(first, len(pairs))), pairs[first] // most, pairs[first] % most
        ends = np.searchsorted(of, np.arange(len(lengths) + 1))
        share = n / lengths[of]
        even = np.bincount(of, share * share, len(lengths))  # of two words drawn, how often they are one
        twice = np.bincount(owner[1:][(words[1:] == words[:-1]) & (owner[1:] == owner[:-1])], minlength=len(lengths))
        for i in np.flatnonzero(lengths):
            a, b = ends[i], ends[i + 1]
            means = np.stack((share[a:b], np.full(b - a, 1 / (b - a)))).astype(np.float32)
            out[i, : 2 * width] = (means @ self.vectors.take(different[a:b], axis=0)).ravel()
            out[i, 2 * width :] = np.log1p(lengths[i]), np.log1p(b - a), (b - a) / lengths[i], even[i], twice[i] / lengths[i]
        return out

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((features - self.mean) / self.scale @ w1 + b1) @ w2 + b2[0]

    def probabilities(self, features: np.ndarray, empty: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(features), self.base)
        z = self.logits(features) / self.temperature
        return np.where(empty, self.base, 1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, *, hidden: int = 32, rounds: int = 60, batch: int = 64, decay: float = 1e-3, rate: float = 3e-3, seed: int = 5) -> list[np.ndarray]:
    """Weights of a two-layer network for a weighted logistic loss, by Adam; equal inputs give equal weights."""
    r = np.random.default_rng(seed)
    layers = [r.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), r.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    step, total = 0, rounds * -(-len(x) // batch)
    weight = weight / weight.mean()
    for _ in range(rounds):
        order = r.permutation(len(x))
        for at in range(0, len(x), batch):
            i = order[at : at + batch]
            w1, b1, w2, b2 = layers
            h = np.tanh(x[i] @ w1 + b1)
            error = weight[i] * (1 / (1 + np.exp(-np.clip(h @ w2 + b2[0], -30, 30))) - y[i]) / len(i)
            back = np.outer(error, w2) * (1 - h * h)
            step += 1
            now = rate * 0.5 * (1 + np.cos(np.pi * step / total))
            for p, a, b, g in zip(layers, first, second, (x[i].T @ back, back.sum(axis=0), h.T @ error, np.array([error.sum()])), strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= now * (a / (1 - 0.9**step) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8) + (decay * p if p.ndim == 2 else 0))
    return layers


def temperature(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The divisor of the logits that makes the weighted logistic loss least, by golden section over its logarithm."""

    def loss(t: float) -> float:
        s = np.where(y > 0, -1.0, 1.0) * z / np.exp(t)
        return float((weight * np.logaddexp(0, s)).sum())

    lo, hi, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    for _ in range(60):
        if loss(a) <= loss(b):
            hi, b = b, a
            a = hi - g * (hi - lo)
        else:
            lo, a = a, b
            b = lo + g * (hi - lo)
    return float(np.exp((lo + hi) / 2))


def _vocabulary(texts: DataFrame, least: int) -> list[str]:
    """The words that ``least`` texts of the sample hold, or more, in order; before them the shapes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                held.update({w for part in spaced(text.as_py()) for w in part.split()})
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["w", "n"])

    counts = texts.select("text").mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    words = sorted(r["w"] for r in counts.select("w").collect())  # words of the sample
    lengths = [*range(1, 13), 30]
    return [f"{kind} {n}" for kind in ("letters", "digits", "mixed", "mark") for n in lengths] + words


def _contexts(docs: DataFrame, vocabulary: list[str], size: int) -> np.ndarray:
    """Context vectors of the vocabulary, counted over all documents; Spark adds up what each task has counted."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        known = _Known(vocabulary, size)
        table = np.zeros((len(vocabulary), size), np.int64)

        def add(ids: np.ndarray, lengths: np.ndarray) -> None:
            at = np.arange(len(ids)) + REACH * (np.repeat(np.arange(len(lengths)), lengths) + 1)
            padded = np.full(len(ids) + REACH * (len(lengths) + 1), len(known))  # between texts stands a word whose vector is 0
            padded[at] = ids
            vectors = np.concatenate((index_vectors(known.places, size), np.zeros((1, size), np.int8)))
            ordered = np.sort(np.array(known.as_known, np.int64)[ids] << 32 | at)  # places of a word stand together
            for b in range(0, len(ordered), 8192):
                word, place = ordered[b : b + 8192] >> 32, ordered[b : b + 8192] & 0xFFFFFFFF
                near = np.zeros((len(place), size), np.int8)
                for d in range(1, REACH + 1):
                    near += vectors.take(padded[place - d], axis=0)
                    near += vectors.take(padded[place + d], axis=0)
                first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                table[word[first]] += np.add.reduceat(near, first, axis=0, dtype=np.int32)

        for batch in batches:
            for texts in bunches(batch.column(0)):
                add(*numbered_all(texts, known))
                known.trim()
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(table[used, j]) for j in range(size)]], ["w", *[f"v{j}" for j in range(size)]])

    parts = docs.select("text").mapInArrow(work, ", ".join(["w long", *[f"v{j} long" for j in range(size)]]))
    names = [f"v{j}" for j in range(size)]
    table = parts.groupBy("w").agg(*[F.sum(c).alias(c) for c in names]).toArrow()  # bounded by the vocabulary
    shared.destroy()
    out = np.zeros((len(vocabulary), size))
    out[table["w"].to_numpy()] = np.stack([table[c].to_numpy() for c in names], axis=1)
    return out


def word_vectors(contexts: np.ndarray, vocabulary: list[str], size: int) -> np.ndarray:
    """Context vectors, each of length one before and after the mean of all is taken out, beside index vectors of length one."""

    def unit(v: np.ndarray) -> np.ndarray:
        v /= np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-9)[:, None]
        return v

    learnt = unit(contexts.astype(np.float32))
    seen = contexts.any(axis=1)
    if seen.any():
        learnt[seen] = unit(learnt[seen] - learnt[seen].mean(axis=0, dtype=np.float64).astype(np.float32))
    return np.concatenate((learnt, unit(index_vectors([word_hash(w) for w in vocabulary], size).astype(np.float32))), axis=1)


def fit(docs: DataFrame, labels: DataFrame, *, sample_per_class: int = 8192, size: int = 64, least: int = 8, held_out: int = 1) -> Model:
    """A model of at most ``sample_per_class`` labelled rows of each class, those with the least hashes.

    Rows whose crc32(doc_id as text) mod 3 is ``held_out`` are never learnt from; of
    the others every fifth, by hash, fits the temperature. Context vectors count all
    documents, without labels. Of several labels of a doc_id the least counts. Equal
    tables give equal models, however they are partitioned.
    """
    scratch = Scratch(docs.sparkSession, "quality-model")
    known = labels.filter("quality is not null and doc_id is not null").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != held_out)
    known = scratch.table(known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).withColumn("h", F.xxhash64(F.lit(7), "doc_id")))
    total = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    chosen = None
    for c in (0, 1):
        part = known.filter(F.col("quality") == c).orderBy("h", "doc_id").limit(sample_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # bounded by sample_per_class
    texts = scratch.table(texts.select("quality", "h", "text").distinct())
    vocabulary = _vocabulary(texts, least)
    model = Model(vocabulary, size)
    model.vectors = word_vectors(_contexts(docs, vocabulary, size), vocabulary, size)
    model.base = (total.get(1, 0) + 0.5) / (sum(total.values()) + 1)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Known(shared.value.vocabulary, size)
        for batch in batches:
            for at, got, _ in pooled_of(batch.column(2), shared.value, words):
                x = pa.ListArray.from_arrays(np.arange(0, got.size + 1, got.shape[1], dtype=np.int32), pa.array(got.ravel()))
                yield pa.RecordBatch.from_arrays([c.slice(at, len(got)) for c in batch.columns[:2]] + [x], ["quality", "h", "x"])

    rows = texts.mapInArrow(pool, "quality int, h long, x array<float>").toArrow()  # bounded by sample_per_class
    shared.destroy()
    y, h = rows["quality"].to_numpy().astype(float), rows["h"].to_numpy()
    if len(set(y)) < 2:
        return model
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(len(y), -1).astype(float)
    order = np.lexsort((*x.T[::-1], y, h))
    x, y, h = x[order], y[order], h[order]
    found = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.where(y > 0, total[1] / found[1], total[0] / found[0])
    learn = h % 5 != 0
    if len(set(y[learn])) < 2:
        learn[:] = True
    model.mean, model.scale = x[learn].mean(axis=0), x[learn].std(axis=0) + 1e-6
    model.layers = train((x[learn] - model.mean) / model.scale, y[learn], weight[learn])
    rest = ~learn if len(set(y[~learn])) == 2 else learn
    model.temperature = temperature(model.logits(x[rest]), y[rest], weight[rest])
    return model


def pooled_of(texts: pa.Array, model: Model, words: _Known) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Features of whole texts, and which have no word; some thousands at a time, each time with the number of the first."""
    at = 0
    for held in bunches(texts):
        words.trim()
        numbers, lengths = numbered_all(held, words)
        yield at, model.pooled(np.array(words.as_known, np.int64)[numbers], lengths), lengths == 0
        at += len(held)


def score(docs: DataFrame, model: Model, *, held_out: int = 1, cutoff: float = 0.5) -> DataFrame:
    """One row per document: doc_id, held_out, score (of quality 1), predicted.

    docs: doc_id, text; other columns aren't read. Defined results: NULL and empty
    texts, and those of white space alone, get the share of quality 1 among labelled
    rows, or 0.5 without any; so do all texts if only one label was there to learn;
    repeated rows give repeated results; a NULL doc_id isn't held out; an empty
    table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words = _Known(model.vocabulary, model.size)
        for batch in batches:
            for at, features, empty in pooled_of(batch.column(1), model, words):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(features)), pa.array(model.probabilities(features, empty))], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == held_out, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))
