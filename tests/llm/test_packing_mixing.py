"""Packing by exact round trip, mixing by exact totals."""

import functools
import random
import re
import zlib
from collections import Counter, defaultdict

import llm_cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import mixing, packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@functools.cache
def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer()).encode(text or "", add_special_tokens=False).ids + [0]


def test_encoder_agrees_with_the_library():
    from tokenizers import Tokenizer

    encoder, library = packing._Encoder(packing.default_tokenizer()), Tokenizer.from_file(packing.default_tokenizer())
    for t in ["", " ", "\n\n", "a  b \n c d 　 e", "it's <|endoftext|> here", "日本 é😀 12 345!?", "x" * 5000, "\x00�", *[t or "" for _, t in llm_cases.texts()]]:
        assert np.frombuffer(encoder.ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [64, 2048])
def test_round_trip(spark, capacity):
    rows = llm_cases.texts()
    got = packing.pack(packing.token_pieces(llm_cases.documents(spark, rows), capacity=capacity), capacity=capacity).collect()
    sequences, texts = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        texts[r.doc_id].append((r.piece, r.start, r.length, r.ids))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    want = sorted(repr((d, np.array(ids_of(t), "<u4").tobytes())) for d, t in rows)
    back = []
    for d, pieces in texts.items():
        # repeated rows give repeated pieces; put texts together start by start
        heads = [p for p in pieces if p[0] == 0]
        rest = sorted(p for p in pieces if p[0] > 0)
        for head in heads:
            out, at = head[3], head[2]
            while (nxt := next((p for p in rest if p[1] == at and any(len(w) // 4 > at and w.startswith(out + p[3]) for w in [np.array(ids_of(t), "<u4").tobytes() for i, t in rows if i == d])), None)) is not None:
                rest.remove(nxt)
                out, at = out + nxt[3], at + nxt[2]
            back.append(repr((d, out)))
        assert not rest
    assert sorted(back) == want
    for r in got:
        assert r.length == capacity or r.piece == 0
        assert len(r.ids) == 4 * r.length
    assert got and len(sequences) >= -(-sum(r.length for r in got) // capacity)


def test_nothing_to_pack(spark):
    assert packing.pack(packing.token_pieces(llm_cases.empty(spark))).count() == 0


@pytest.mark.parametrize("seed, n, capacity", [(1, 400, 128), (2, 5000, 256), (3, 30, 100)])
def test_plan_holds_all_and_is_tight(seed, n, capacity):
    r = random.Random(seed)
    lengths = [min(capacity, max(1, int(r.lognormvariate(3.2, 1)))) for _ in range(n)]
    histogram = {x: lengths.count(x) for x in set(lengths)}
    configs = packing.plan(histogram, capacity)
    held = defaultdict(int)
    for config, times in configs:
        assert sum(config) <= capacity and times > 0
        for x in config:
            held[x] += times
    assert dict(held) == histogram
    used, bound = sum(t for _, t in configs), -(-sum(lengths) // capacity)
    assert used <= bound + max(1, n // 200)


def test_pricing_is_optimal():
    r = np.random.default_rng(1)
    lengths = np.array([2, 3, 5, 9])
    weights = r.random(4)
    best = packing.price(lengths, weights, 20)

    def brute(room):
        return max([0.0 if room == 0 else -np.inf, *(w + brute(room - n) for n, w in zip(lengths.tolist(), weights.tolist()) if n <= room)])

    assert [best[c] for c in range(21)] == pytest.approx([brute(c) for c in range(21)])


@pytest.mark.parametrize("times", [1, 100])
def test_program_does_the_work(spark, times):
    """On the lengths of the documents: the program's value is within 1 % of the bound, under 5 % of the sequences are left to the last fill, and the total is next to the least that any packing has."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    histogram = {r["length"]: r["n"] * times for r in packing.token_pieces(docs).groupBy("length").agg(F.count("*").alias("n")).collect()}
    demand = np.zeros(2049, np.int64)
    for n, k in histogram.items():
        demand[n] = k * (n < 2048)
    found, rest = packing.solve(demand)
    bound = (demand * np.arange(2049)).sum() / 2048
    left = (rest * np.arange(2049)).sum() / 2048
    assert all(sum(config) == 2048 for config, _ in found)
    assert left <= 0.05 * bound and sum(n for _, n in found) + packing_total(rest) <= 1.01 * bound + 1
    assert sum(n for _, n in packing.plan(histogram, 2048)) <= -(-sum(n * k for n, k in histogram.items()) // 2048) * 1.003 + 1
    again, _ = packing.solve(demand)
    assert again == found


def packing_total(rest):
    return sum(n for _, n in packing.plan({i: int(k) for i, k in enumerate(rest) if k}, len(rest) - 1))


def test_plan_is_optimal_where_brute_force_can_tell():
    """Against the least number of bins over all packings of few pieces."""
    r = random.Random(5)

    def least(sizes, capacity):
        sizes, best = sorted(sizes, reverse=True), [len(sizes)]

        def place(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(sizes):
                best[0] = len(bins)
                return
            for at in {b: k for k, b in enumerate(bins)}.values():
                if bins[at] + sizes[i] <= capacity:
                    place(i + 1, bins[:at] + [bins[at] + sizes[i]] + bins[at + 1 :])
            place(i + 1, [*bins, sizes[i]])

        place(0, [])
        return best[0]

    over = 0
    for _ in range(60):
        sizes = [r.randrange(3, 20) for _ in range(r.randrange(1, 9))]
        used = sum(n for _, n in packing.plan(dict(Counter(sizes)), 20))
        over += used - least(sizes, 20)
    assert 0 <= over <= 3


def test_other_tokenizers_take_the_library(tmp_path):
    import json

    with open(packing.default_tokenizer(), encoding="utf-8") as f:
        told = json.load(f)
    assert packing._Encoder(packing.default_tokenizer()).fast is not None
    text = "It's  12 x\n\n日本 lower"
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": told["pre_tokenizer"] | {"add_prefix_space": True}}, {"pre_tokenizer": told["pre_tokenizer"] | {"use_regex": False}}, {"model": told["model"] | {"ignore_merges": True}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(told | change), encoding="utf-8")
        from tokenizers import Tokenizer

        encoder = packing._Encoder(str(path))
        assert encoder.fast is None
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids


def fill(sizes, weights=(5, 2, 1), cap=3):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        left, pot = [s for s in names if s not in done], total - sum(done.values())
        share = {s: pot * w[s] / sum(w[x] for x in left) for s in left}
        over = {s for s in left if share[s] > cap * sizes[s]}
        if not over:
            return done | share
        done |= {s: cap * sizes[s] for s in over}


def test_mix_meets_targets(spark):
    rows = llm_cases.texts() + [(1000 + i, llm_cases.prose(i, 20 + i)) for i in range(60)]
    docs = llm_cases.documents(spark, rows)
    sizes, per = defaultdict(int), {}
    for r in docs.select("source", "text").collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want = fill(dict(sizes))
    mixed = mixing.mix(docs, shard_words=4000, block_words=50).cache()
    got = mixing.words_taken(mixed)
    assert got.count() == len(rows)
    by_size = {v: k for k, v in sizes.items()}
    taken = defaultdict(int)
    for r in got.collect():
        s = by_size[r.source_size]
        per[s] = r.target
        taken[s] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    block = {s: min(50, max(1, n // 512)) for s, n in sizes.items()}
    for s in sizes:
        assert per[s] == pytest.approx(want[s]) and abs(taken[s] - per[s]) <= block[s] + 1
    again = mixing.words_taken(mixing.mix(docs.repartition(3), shard_words=4000, block_words=50))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, got.collect()))
    rows = mixed.filter("words > 0").collect()
    counts = Counter()
    for r in rows:
        counts[r.shard] += r.words
    assert sorted(counts) == list(range(-(-sum(taken.values()) // 4000))) and len(counts) > 3
    # no word of a pass is dealt twice, and stretches are those of the rows
    seen = defaultdict(list)
    for r in rows:
        seen[r.source, r.at, r["pass"]].append((r.word_from, r.words, r.size))
    for x in seen.values():
        x.sort()
        assert all(a + n <= b for (a, n, _), (b, _, _) in zip(x, x[1:])) and x[-1][0] + x[-1][1] <= x[-1][2]
    told = Counter(tuple(map(int, x.split(":"))) for r in got.collect() for x in r.stretches.split(",") if x)
    assert told == Counter((r.shard, r.position, r["pass"], r.word_from, r.words) for r in rows)


def test_draws_decide_what_is_taken(spark, monkeypatch):
    """Other draws take other documents, to the same totals; shards hold the sources as their shares say."""
    rows = [(i, llm_cases.prose(i, 30 + i % 40)) for i in range(300)]
    docs = llm_cases.documents(spark, rows)
    take = lambda **o: {r.doc_id: r for r in mixing.words_taken(mixing.mix(docs, shard_words=1000, block_words=20, **o)).collect()}
    first = take()
    split = mixing.split_quotas

    def flat(node, quotas, drawn, seed):
        """All of the first strata go left: no hypergeometric draw."""
        return F.aggregate(quotas, F.struct(drawn.cast("long").alias("d"), F.array().cast("array<bigint>").alias("o")), lambda a, q: F.struct((a["d"] - F.least(q, a["d"])).alias("d"), F.concat(a["o"], F.array(F.least(q, a["d"]))).alias("o")), lambda a: a["o"])

    monkeypatch.setattr(mixing, "split_quotas", flat)
    other = take()
    assert sum(first[i].taken != other[i].taken for i in first) > 10 and sum(first[i].stretches != other[i].stretches for i in first) > 100
    total = lambda x: sorted(Counter({s: sum(r.taken for r in x.values() if r.source_size == s) for s in {r.source_size for r in x.values()}}).items())
    assert all(abs(a[1] - b[1]) <= 40 for a, b in zip(total(first), total(other), strict=True))
    monkeypatch.setattr(mixing, "split_quotas", split)
    shares = Counter()
    for r in mixing.mix(docs, shard_words=1000, block_words=20).filter("words > 0").collect():
        shares[r.shard, r.source] += r.words
    whole = Counter()
    for (_, s), n in shares.items():
        whole[s] += n
    for s, n in whole.items():
        each = [shares[k, s] for k in {k for k, _ in shares}]
        assert max(each) > min(each) and abs(np.mean(each) - n / len(each)) < 1


def test_mixed_documents_hold_the_words(spark):
    rows = llm_cases.texts() + [(1000 + i, llm_cases.prose(i, 20 + i)) for i in range(40)]
    docs = llm_cases.documents(spark, rows)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = sum(len(WORD.findall(r.text)) for r in out.collect())
    texts = {t for _, t in rows if t}
    assert all(r.text in texts or any(r.text in t for t in texts) for r in out.collect())
    assert words == mixing.words_taken(mixing.mix(docs)).agg(F.sum("taken")).first()[0]


def test_mix_of_nothing(spark):
    assert mixing.mix(llm_cases.empty(spark)).count() == 0 and mixing.mixed_documents(llm_cases.empty(spark)).count() == 0
    assert [r.taken for r in mixing.words_taken(mixing.mix(llm_cases.documents(spark, [(1, None), (1, None), (2, " ")]))).collect()] == [0, 0, 0]


@pytest.mark.parametrize("total, marked, drawn", [(1000, 300, 200), (20, 20, 7), (50, 0, 9), (40, 13, 40), (100_000, 3, 50_000)])
def test_hypergeometric_moments(spark, total, marked, drawn):
    u = (F.col("id") + 0.5) / 4000
    x = spark.range(4000).select(mixing.hypergeometric(F.lit(total), F.lit(marked), F.lit(drawn), u).alias("x"))
    r = x.agg(F.avg("x"), F.var_pop("x"), F.min("x"), F.max("x")).first()
    p = marked / total
    variance = drawn * p * (1 - p) * (total - drawn) / (total - 1)
    assert r[0] == pytest.approx(drawn * p, abs=0.02 * (1 + variance**0.5)) and r[1] == pytest.approx(variance, rel=0.05, abs=0.01)
    assert max(0, drawn + marked - total) <= r[2] and r[3] <= min(marked, drawn)


def test_crc_of_ids(spark):
    row = packing.token_pieces(llm_cases.documents(spark, [(1, "hello world")])).withColumn("c", F.crc32("ids")).first()
    assert row.c == zlib.crc32(np.array(ids_of("hello world"), "<u4").tobytes())
