"""Collocations by suffixes that are dealt by first word, sorted and counted with one stack.

Texts are read once into chunks of about two million words, in which a word is a
number. The words of all chunks are counted exactly, as strings, per language; a
word's id is its place in the first chunk that holds it. No phrase is more frequent
than its words, so that texts are split at the others as they are at punctuation.
A chunk then makes, for every word, the suffix of at most ``max_n`` words that
begins there, adds up equal ones and deals them by language and first word (ids are
of one language). Hot words, with more suffixes than a part shall hold, are dealt
by further words, up to the first that isn't hot: no part gets more of one key than
that word is frequent. A part sorts its suffixes in reverse order, so
that a phrase follows all that extend it, and one pass with a stack of open phrases
counts every prefix; prefixes of hot words alone are counted in several parts and
added up. What is left is joined: the parts of each cut, the longer
phrases that hold a shorter one, the words' spelling.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.scratch import Scratch

from .lm_score import _packed, _unpacked

#: Bytes of a text that are split at once, about.
SLICE = 4_000_000

_BREAK = b"\xff"  # no byte of UTF-8
_BREAKS = b".,;:!?\n\v\f\r"
_TABLE = bytes.maketrans(string.ascii_uppercase.encode() + _BREAKS + b"\t", string.ascii_lowercase.encode() + _BREAK * len(_BREAKS) + b" ")
_CHUNKS = "chunk long, words array<struct<lang:string,word:string,n:long>>, tokens binary, n_tokens long"


class _Numbers(dict):
    """Numbers of one language's words, from 1, in a list that languages share; 0 is a break."""

    def __init__(self, lang: str, names: list[tuple[str, bytes]]):
        self.lang, self.names = lang, names
        self[_BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        self.names.append((self.lang, word))
        self[word] = n = len(self.names)
        return n


def numbered(data: bytes, numbers: dict[bytes, int]) -> Iterator[np.ndarray]:
    """The numbers of a text's words, with zeros between pieces, slice by slice."""
    data = data.translate(_TABLE)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE) if len(data) - at > SLICE else -1
        end = end if end >= 0 else len(data)
        words = data[at:end].replace(_BREAK, b" \xff ").split()
        yield np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))
        at = end


def _chunks(docs: DataFrame, size: int) -> DataFrame:
    """The documents in chunks, by _CHUNKS: a token is a word's place in words, from 1, or 0 between pieces. Chunks end with a document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 12
        names: list[tuple[str, bytes]] = []
        numbers: dict[str, _Numbers] = {}
        parts: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            tokens = np.concatenate(parts)
            n = np.bincount(tokens, minlength=len(names) + 1)[1:]
            words = pa.StructArray.from_arrays([pa.array([x for x, _ in names], pa.string()), pa.array([x for _, x in names], pa.binary()).cast(pa.string()), pa.array(n)], ["lang", "word", "n"])
            columns = [pa.array([chunk]), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.array([_packed(tokens)]), pa.array([len(tokens)])]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "words", "tokens", "n_tokens"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = numbers.get(lang)
                if own is None:
                    numbers[lang] = own = _Numbers(lang, names)
                for got in numbered(text.as_py() or b"", own):
                    parts.append(got)
                    held += len(got)
                parts.append(np.zeros(1, np.uint32))
                if held >= size:
                    yield out()
                    chunk, held = chunk + 1, 0
                    names.clear()
                    numbers.clear()
                    parts.clear()
        if held:
            yield out()

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")), F.col("text").cast("binary"))
    return texts.mapInArrow(work, _CHUNKS)


def suffixes(ids: np.ndarray, max_n: int) -> tuple[np.ndarray, np.ndarray]:
    """The different suffixes of two words or more of a row of ids (0: a break), each cut at max_n words and filled with 0, and how often they are there."""
    columns = [ids]
    for j in range(1, max_n):
        shifted = np.concatenate((ids[j:], np.zeros(min(j, len(ids)), ids.dtype)))
        columns.append(np.where(columns[-1] > 0, shifted, 0))
    keep = columns[1] > 0
    columns = [c[keep] for c in columns]
    bits = int(ids.max(initial=1)).bit_length()
    fit = max(1, 64 // bits)  # words to a key
    keys = []
    for at in range(0, max_n, fit):
        key = columns[at].astype(np.uint64)
        for c in columns[at + 1 : at + fit]:
            key = key << np.uint64(bits) | c.astype(np.uint64)
        keys.append(key)
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return np.stack([c[order[first]] for c in columns], axis=1), np.diff(np.append(first, len(order)))


def mixed(x: np.ndarray) -> np.ndarray:
    """Scattered 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _deal(chunks: DataFrame, marked: DataFrame, parts: int, size: int, max_n: int) -> DataFrame:
    """(part, n, rows, counts): what each chunk has for each part."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("rows", pa.binary()), ("counts", pa.binary())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        tokens = _unpacked(left["tokens"][0].as_py(), left["n_tokens"][0].as_py(), np.uint32)
        k, word, f = (right[c].to_numpy() for c in ("k", "id", "f"))
        local = np.zeros(int(tokens.max(initial=0)) + 1, np.uint32)
        local[k] = np.arange(1, len(k) + 1, dtype=np.uint32)
        rows, counts = suffixes(local[tokens], max_n)
        word = np.concatenate(([0], word)).astype(np.uint64)
        hot = np.concatenate(([False], f > size))[rows]
        rows = word[rows]
        open_, part = np.ones(len(rows), bool), np.zeros(len(rows), np.uint64)
        for j in range(max_n):
            part = np.where(open_, mixed(part + rows[:, j]), part)
            open_ &= hot[:, j]
        part = part % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        part, rows, counts = part[order].astype(np.int64), rows[order], counts[order].astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.empty(0, np.int64)
        ends = np.append(starts[1:], len(part))
        columns = [[int(part[s]) for s in starts], [int(e - s) for s, e in zip(starts, ends, strict=True)]]
        columns += [[_packed(rows[s:e].T.copy()) for s, e in zip(starts, ends, strict=True)], [_packed(counts[s:e]) for s, e in zip(starts, ends, strict=True)]]
        return pa.table(columns, schema=schema)

    left = chunks.select("chunk", "tokens", "n_tokens").groupBy("chunk")
    return left.cogroup(marked.select("chunk", "k", "id", "f").groupBy("chunk")).applyInArrow(work, "part long, n long, rows binary, counts binary")


def count_prefixes(rows: np.ndarray, counts: np.ndarray, least: int, free: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, length, count) of every prefix of two or more ids that comes ``least`` times or more, and of those within the first free[row] ids, in one pass over reverse-sorted rows.

    The stack holds the prefixes of the row at hand, with what was counted for each;
    the next row closes those that it doesn't share, and what a closed one counted
    goes to the one below.
    """
    width = rows.shape[1]
    depth = (rows > 0).sum(axis=1)
    same = np.cumprod((rows[1:] == rows[:-1]) & (rows[1:] > 0), axis=1).sum(axis=1) if len(rows) > 1 else np.empty(0, np.int64)
    open_ = [0] * (width + 1)
    top = last = 0
    for i, (shared, d, c, f) in enumerate(zip([0, *same.tolist()], depth.tolist(), counts.tolist(), free.tolist(), strict=True)):
        while top > shared:
            n = open_[top]
            open_[top] = 0
            if top > 1 and (n >= least or top <= last):
                yield i - 1, top, n
            top -= 1
            open_[top] += n
        if shared == 0:
            open_[0] = 0
        top, last = d, f
        open_[d] += c
    while top > 1:
        n = open_[top]
        if n >= least or top <= last:
            yield len(rows) - 1, top, n
        top -= 1
        open_[top] += n


def _phrases(dealt: DataFrame, hot: list[int], max_n: int, least: int) -> DataFrame:
    """(words, f): phrases of two words or more with their frequencies, least or more. hot: ids of words that are dealt by further words."""
    shared = dealt.sparkSession.sparkContext.broadcast(np.array(sorted(hot), np.uint64))

    def work(table: pa.Table) -> pa.Table:
        sizes = table["n"].to_pylist()
        rows = np.concatenate([_unpacked(x.as_py(), n * max_n, np.uint64).reshape(max_n, n).T for x, n in zip(table["rows"], sizes, strict=True)])
        counts = np.concatenate([_unpacked(x.as_py(), n, np.int64) for x, n in zip(table["counts"], sizes, strict=True)])
        order = np.lexsort(rows.T[::-1])[::-1]
        rows, counts = rows[order], counts[order]
        free = np.cumprod(np.isin(rows, shared.value), axis=1).sum(axis=1)
        found = np.array(list(count_prefixes(rows, counts, least, free)), np.int64).reshape(-1, 3)
        at = np.concatenate(([0], np.cumsum(found[:, 1]))).astype(np.int32)
        picked = rows[found[:, 0]][np.arange(max_n)[None, :] < found[:, 1][:, None]]
        return pa.table({"words": pa.ListArray.from_arrays(pa.array(at), pa.array(picked.astype(np.int64))), "f": pa.array(found[:, 2])})

    found = dealt.groupBy("part").applyInArrow(work, "words array<long>, f long")
    return found.groupBy("words").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def _wide(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def _inner(words: Column) -> Column:
    """All shorter phrases of two words or more inside a phrase."""
    lengths = F.sequence(F.lit(2), F.size(words) - 1)
    return F.array_distinct(F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda s: F.slice(words, s, n)))))


def mine(docs: DataFrame, *, max_n: int = 4, least: int = 30, cover: int = 80, top: int | None = 2000, chunk_words: int = 2_000_000, part_rows: int = 1_000_000) -> DataFrame:
    """The phrases of two to max_n words that keep together: lang, rank, phrase, a, l, r, n, score.

    A phrase counts ``a``, its parts at the weakest cut ``l`` and ``r``, all words of
    its language ``n``; the score is 2,000,000 a div (l + r), in whole numbers of any
    size. Phrases of which ``cover`` percent stand inside one longer phrase are left
    out. ``top``: as many of each language, None for all. Chunks have about
    ``chunk_words`` words, parts about ``part_rows`` suffixes.

    docs: text, lang; other columns aren't read. Defined results: NULL and empty
    texts have no words; a NULL lang is ``und``; repeated rows count as often as they
    are there; equal scores go by frequency, then by the phrase's bytes; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    chunks = scratch.table(_chunks(docs, chunk_words))
    n_of = chunks.select(F.inline("words")).groupBy("lang").agg(F.sum("n").alias("n"))
    place = chunks.select("chunk", F.posexplode("words").alias("i", "w")).select("chunk", (F.col("i") + 1).alias("k"), "w.*")
    every = Window.partitionBy("lang", "word")
    own = F.shiftleft(F.col("chunk"), 31) + F.col("k")
    marked = scratch.table(place.withColumns({"own": own, "f": F.sum("n").over(every)}).filter(F.col("f") >= least).withColumn("id", F.min("own").over(every)))
    spelled = scratch.table(marked.filter("id = own").select("id", "lang", "word", "f"))
    total = spelled.agg(F.sum("f")).first()[0] or 0
    parts = max(-(-total // part_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = [r["id"] for r in spelled.filter(F.col("f") > part_rows).select("id").collect()]  # at most a word for each part
    phrases = scratch.table(_phrases(_deal(chunks, marked, parts, part_rows, max_n), hot, max_n, least))

    known = phrases.unionByName(spelled.select(F.array("id").alias("words"), "f"))
    cuts = phrases.select("words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("words", F.lit(1), F.col("k")), "right": F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))})
    cuts = cuts.join(known.select(F.col("words").alias("left"), F.col("f").alias("l")), "left").join(known.select(F.col("words").alias("right"), F.col("f").alias("r")), "right")
    cuts = cuts.withColumns({"_x": F.lit(2_000_000).cast("decimal(7,0)") * _wide("a"), "_y": _wide("l") + _wide("r")}).withColumn("score", F.expr("_x div _y"))
    scored = cuts.groupBy("words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = phrases.filter(F.size("words") > 2).select(F.col("f"), F.explode(_inner(F.col("words"))).alias("words")).groupBy("words").agg(F.max("f").alias("b"))
    left = scored.join(longer, "words", "left").filter(F.col("b").isNull() | (F.lit(100) * _wide("b") < F.lit(cover) * _wide("a")))
    left = left.select(F.col("words")[0].alias("id"), "words", "a", "cut.l", "cut.r", "cut.score").join(spelled.select("id", "lang"), "id").drop("id")
    if top is not None:
        left = left.withColumn("_r", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).filter(F.col("_r") <= top).drop("_r")
    left = scratch.table(left)
    written = left.select("words", F.posexplode("words").alias("at", "id")).join(spelled.select("id", "word"), "id").groupBy("words").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    out = left.join(written, "words").join(n_of, "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = out.withColumn("rank", rank.cast("long"))
    out = out if top is None else out.filter(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])
