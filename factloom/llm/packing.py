"""Best-fit packing of token sequences by a configuration linear program.

A configuration is a multiset of piece lengths that fits one sequence. The
program asks for the least number of configurations that cover the histogram of
lengths; no solution is below the total length over the capacity, and one of full
configurations alone reaches that. Multiplicative weights solve it in phases: a
phase is given its share of the demand and prices configurations with a knapsack
dynamic program over the weights, the greatest value that fills each room to the
last token; configurations are read from that table for as long as the share
lasts, and lengths that the phase leaves uncovered gain weight for the next one.
Shares and amounts are whole numbers, so that the solution is rounded as it is
found. What all phases leave is priced again until nothing full is found, and the
rest, a small part, is packed pattern by pattern, each the fullest that a
subset-sum dynamic program finds for the longest length left.

Only the histogram (one number per length, at most ``capacity`` of them) and the
plan (a few configurations per length and phase) meet on the driver. The pieces
get their places from their rank among the pieces of their length, counted by
hash buckets, so that a common length is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.scratch import Scratch

from .text import field_of, rows_of

_encoders: dict[str, _Encoder] = {}


#: Fixed value: how byte-level BPE splits a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _is_plain(told: dict, letters: dict[str, int], added: list[str]) -> bool:
    """Whether a tokenizer's file asks for nothing but byte-level BPE, splits by SPLIT and merges in the vocabulary's order."""
    model, split = told["model"], told.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    if told.get("normalizer") or told.get("truncation") or told.get("padding"):
        return False
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return False
    vocab = model["vocab"]
    if any(c not in letters for w in vocab if w not in added for c in w) or any(chr(c) not in vocab for c in map(ord, letters)):
        return False
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    numbers = [vocab.get(w, -1) for w in made]
    return all(a < b for a, b in zip([-1, *numbers], numbers)) and len(made) + len(letters) == sum(w not in added for w in vocab)


class _Encoder:
    """Token ids of texts, as little-endian bytes, by the tokenizer of a file.

    A plain byte-level BPE is merged by tiktoken, which gives the same ids several
    times as fast; other tokenizers, and texts that hold an added token's string,
    take the tokenizers library.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.added = [t["content"] for t in told.get("added_tokens") or []]
        letters = _letters()
        if _is_plain(told, letters, self.added):
            import tiktoken

            ranks = {bytes(letters[c] for c in w): i for w, i in told["model"]["vocab"].items() if w not in self.added}
            self.fast = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast is None or any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_pieces(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0, flush: int = 8 << 20) -> DataFrame:
    """(doc_id, piece, start, length, ids): the token ids of each text and the end id, as little-endian unsigned 32-bit integers.

    Only texts over ``capacity`` are cut, into pieces of ``capacity``; their first
    piece is the rest and may be shorter. NULL counts as empty: the end id alone.
    """
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = _Encoder(path)
        encode = _encoders[path].ids
        names = ["doc_id", "piece", "start", "length", "ids"]
        for batch in batches:
            rows, piece, start, length, ids, size = [], [], [], [], [], 0

            def out(batch=batch):
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names)

            for r, text in enumerate(batch.column(1)):
                got = encode(text.as_py() or "") + end
                n = len(got) // 4
                at, k = 0, 0
                while at < n:
                    step = (n % capacity or capacity) if at == 0 and n > capacity else min(capacity, n)
                    rows.append(r)
                    piece.append(k)
                    start.append(at)
                    length.append(step)
                    ids.append(got[4 * at : 4 * (at + step)])
                    at, k = at + step, k + 1
                size += len(got)
                if size > flush:
                    yield out()
                    rows, piece, start, length, ids, size = [], [], [], [], [], 0
            if rows:
                yield out()

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, piece int, start long, length long, ids binary")


def price(lengths: np.ndarray, weights: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack: for each room, the greatest weight of lengths (rising) that fill it exactly; -inf where none do."""
    best = np.full(capacity + 1, -np.inf)
    best[0] = 0
    for room in range(int(lengths[0]), capacity + 1):
        m = int(np.searchsorted(lengths, room, "right"))
        best[room] = (weights[:m] + best[room - lengths[:m]]).max()
    return best


def phase(demand: np.ndarray, weight: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Full configurations and how often to use each, within the demand (index: length), and the demand left.

    For each length, the longest first, the rest of the sequence is read from the
    priced table, always the best length of which the demand has some left.
    """
    capacity = len(demand) - 1
    lengths = np.flatnonzero(demand)
    out: list[tuple[tuple[int, ...], int]] = []
    left = np.zeros_like(demand)
    if not len(lengths):
        return out, left
    have, weights = demand[lengths], weight[lengths]
    best = price(lengths, weights, capacity)
    for i in range(len(lengths) - 1, -1, -1):
        while have[i] > 0:
            count, room = {i: 1}, capacity - int(lengths[i])
            have[i] -= 1
            while room:
                m = int(np.searchsorted(lengths, room, "right"))
                value = np.where(have[:m] > 0, weights[:m] + best[room - lengths[:m]], -np.inf)
                j = m - 1 - int(value[::-1].argmax()) if m else -1
                if j < 0 or value[j] == -np.inf:
                    break
                count[j] = count.get(j, 0) + 1
                have[j] -= 1
                room -= int(lengths[j])
            for j, k in count.items():
                have[j] += k
            if room:
                break
            times = min(int(have[j]) // k for j, k in count.items())
            for j, k in count.items():
                have[j] -= times * k
            out.append((tuple(sorted((int(lengths[j]) for j, k in count.items() for _ in range(k)), reverse=True)), times))
    left[lengths] = have
    return out, left


def solve(demand: np.ndarray, phases: int = 8, rate: float = 0.5, pieces: int = 50) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Full configurations with amounts for nearly all the demand (index: length), and what is left.

    A share has about ``pieces`` of each length at least, as far as there are so many.
    """
    capacity = len(demand) - 1
    weight = (np.arange(capacity + 1) / capacity) ** 1.05  # longer lengths first, as long as nothing is known
    steps = int(max(1, min(phases, demand.sum() // (pieces * max(1, np.count_nonzero(demand))))))
    out: list[tuple[tuple[int, ...], int]] = []
    left, given = np.zeros_like(demand), 0
    while True:
        share = left + (demand * (given + 1) // steps - demand * given // steps if given < steps else 0)
        found, left = phase(share, weight)
        given += 1
        out += found
        weight = weight * np.exp(rate * left / np.maximum(share, 1))
        if given >= steps and not found:
            return out, left


def fullest(left: list[int], capacity: int, first: int) -> list[int]:
    """``first`` and lengths that are left, as near to the capacity as can be; longer ones before shorter ones."""
    room = capacity - first
    states, reach, mask = [], 1, (1 << (room + 1)) - 1
    for n in range(min(room, len(left) - 1), 0, -1):
        have = left[n] - (n == first)
        copies = min(have, room // n)
        if copies <= 0:
            continue
        states.append((n, copies, reach))
        k = 1
        while copies > 0:
            take = min(k, copies)
            reach |= (reach << (take * n)) & mask
            copies -= take
            k *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, [first]
    for n, copies, before in reversed(states):
        for k in range(copies + 1):
            if at - k * n >= 0 and before >> (at - k * n) & 1:
                out += [n] * k
                at -= k * n
                break
    return sorted(out, reverse=True)


def plan(histogram: dict[int, int], capacity: int, phases: int = 8) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and their whole numbers, holding exactly the lengths of the histogram."""
    demand = np.zeros(capacity + 1, np.int64)
    for n, count in histogram.items():
        demand[int(n)] += int(count)
    out: list[tuple[tuple[int, ...], int]] = []
    if demand[capacity]:
        out.append(((capacity,), int(demand[capacity])))
        demand[capacity] = 0
    found, rest = solve(demand, phases)
    out += found
    left = rest.tolist()
    for n in range(capacity, 0, -1):
        while left[n]:
            config = fullest(left, capacity, n)
            times = min(left[k] // config.count(k) for k in set(config))
            out.append((tuple(config), times))
            for k in config:
                left[k] -= times
    return out


def places(configs: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Per length and stretch of ranks: the first sequence, the copies in a sequence and their first offset, sorted for a binary search."""
    rows, seen, sequence = [], {}, 0
    for config, times in configs:
        offset = 0
        for n in dict.fromkeys(config):
            m = config.count(n)
            rank = seen.get(n, 0)
            rows.append((n, rank, sequence, m, offset))
            seen[n] = rank + times * m
            offset += n * m
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {k: table[:, i] for i, k in enumerate(("length", "rank", "sequence", "copies", "offset"))}


def pack(pieces: DataFrame, *, capacity: int = 2048, phases: int = 8, bucket_rows: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length and further columns).

    Pieces of one length are interchangeable; which one goes where follows from a
    hash, so that reruns agree. Further columns may have any names, but those called
    sequence_id or offset are replaced. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    held = scratch.table(rows_of(pieces))
    counts = {r["length"]: r["n"] for r in held.groupBy(field_of("length").alias("length")).agg(F.count("*").alias("n")).collect()}
    buckets = max(16, sum(counts.values()) // bucket_rows)
    table = spark.sparkContext.broadcast(places(plan(counts, capacity, phases)))
    same = [field_of(c) for c in ("doc_id", "piece", "start")]
    dealt = held.select("row", field_of("length").alias("length"), F.xxhash64(*same).alias("h")).withColumn("b", F.pmod("h", F.lit(buckets)))
    sizes = dealt.groupBy("length", "b").agg(F.count("*").alias("n"))
    before = sizes.select("length", "b", (F.sum("n").over(Window.partitionBy("length").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("length", "b").orderBy("h", *same)).cast("long")
    ranked = dealt.withColumn("r", inner - 1).join(before, ["length", "b"]).select("row", "length", (F.col("r") + F.col("before")).alias("rank"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        stride = int(t["rank"].max()) + (1 << 40) if len(t["rank"]) else 1
        keys = t["length"].astype(object) * stride + t["rank"] if stride * (capacity + 1) > 2**62 else t["length"] * stride + t["rank"]
        for batch in batches:
            length, rank = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            at = np.searchsorted(keys, length * stride + rank, side="right") - 1
            past = rank - t["rank"][at]
            sequence = t["sequence"][at] + past // t["copies"][at]
            offset = t["offset"][at] + past % t["copies"][at] * length
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sequence), pa.array(offset)], ["row", "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructType

    schema = StructType([held.schema["row"]]).add("sequence_id", LongType()).add("offset", LongType())
    kept = [field_of(c).alias(c) for c in pieces.columns if c not in ("sequence_id", "offset")]
    return ranked.mapInArrow(work, schema).select(*kept, "sequence_id", "offset")
