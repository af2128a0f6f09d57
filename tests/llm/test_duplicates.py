"""SimHash groups and repeated passages against brute force."""

import hashlib
import random
from collections import Counter

import llm_cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import components, repeats, simhash
from factloom.scratch import Scratch


def fingerprint(t):
    import xxhash

    w = (t or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(s))


def groups(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_near_duplicates(spark):
    rows = llm_cases.texts()
    fps = [fingerprint(t) for _, t in rows]
    root = groups(len(rows), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(least.get(root[i], d), d)
    want = sorted(repr((d, f"{fps[i]:016x}", least.get(root[i]))) for i, (d, _) in enumerate(rows))
    found = simhash.near_duplicates(llm_cases.documents(spark))
    assert sorted(repr(tuple(r)) for r in found.select("doc_id", simhash.hex_of(found.fp), "component_id").collect()) == want


def test_one_of_each_group_stays(spark):
    docs = llm_cases.documents(spark)
    kept = simhash.keep_one(docs)
    fps = [fingerprint(t) for _, t in llm_cases.texts()]
    assert kept.columns == docs.columns
    assert kept.count() == len(set(groups(len(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)))
    assert simhash.near_duplicates(llm_cases.empty(spark)).count() == 0 and simhash.keep_one(llm_cases.empty(spark)).count() == 0


def family(seed, n, flips):
    r, out = random.Random(seed), set()
    base = r.getrandbits(64)
    while len(out) < n:
        x = base
        for _ in range(r.randrange(flips + 1)):
            x ^= 1 << r.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("dense", [4, 20_000])
def test_links_span_the_same_groups(spark, dense):
    fps = sorted(set(family(1, 150, 3) + family(2, 60, 6) + [random.Random(3).getrandbits(64) for _ in range(100)] + [0, 1, 7, (1 << 64) - 1]))
    want = groups(len(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    scratch = Scratch(spark, "test")
    got = simhash.links(df, scratch, dense=dense, flush=100).collect()
    index = {x: i for i, x in enumerate(fps)}
    edges = {tuple(sorted((index[r.a % 2**64], index[r.b % 2**64]))) for r in got}
    assert groups(len(fps), lambda a, b: (b, a) in edges) == want


def test_bit_sliced_distances():
    r = np.random.default_rng(0)
    fps = r.integers(0, 2**64, (3, 64), dtype=np.uint64)
    fps[0, 1:20] = fps[0, 0] ^ (np.uint64(1) << r.integers(0, 64, 19).astype(np.uint64))
    planes = simhash.planes_of(fps)
    for radius in (0, 1, 2, 3, 5):
        query = simhash._spread(planes & np.uint64(1))
        got = simhash.within(planes, query, np.full(3, simhash.ONES), radius)
        for row in range(3):
            assert [bool(int(got[row]) >> i & 1) for i in range(64)] == [(int(fps[row, i]) ^ int(fps[row, 0])).bit_count() <= radius for i in range(64)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"))
    assert {r.node: r.root for r in got.collect()} == {i: 0 for i in range(1, 31)} | {i: 100 for i in range(101, 140)}


def repeated(rows, window=200):
    data = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + window] for b in data for i in range(len(b) - window + 1))
    out = []
    for (d, _), b in zip(rows, data):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - window + 1):
            if count[b[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def measured(df):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return sorted(repr(tuple(r)) for r in df.select("doc_id", "n_bytes", removed, F.size("spans"), F.sha2("kept", 256)).collect())


@pytest.mark.parametrize("dense", [1, 50_000])
def test_repeats(spark, dense):
    passage = llm_cases.prose(50, 90)
    rows = llm_cases.texts() + [(100 + i, llm_cases.prose(60 + i, 30 + i) + passage[i : 500 - i] + llm_cases.prose(80 + i, 40)) for i in range(12)]
    rows += [(200, "ab" * 500), (201, "é日本" * 90), (202, passage[:199]), (203, "q" + passage[:200] + "q"), (204, passage[:260] + "#" + passage[100:330])]
    assert measured(repeats.remove_repeats(llm_cases.documents(spark, rows), dense=dense)) == repeated(rows)


def test_repeats_of_nothing(spark):
    assert repeats.remove_repeats(llm_cases.empty(spark)).count() == 0


def test_merged_transforms_sort_as_one():
    r = np.random.default_rng(5)
    texts = [r.integers(10, 13, 30) for _ in range(7)]
    ends = iter(range(7))
    shards, whole = [], []
    for part in (texts[:3], texts[3:5], texts[5:]):
        symbols = np.concatenate([np.concatenate((t, [next(ends)])) for t in part])
        shards.append(repeats.shard_transform(symbols))
        whole.append(symbols)
    for depth in (1, 3, 6):
        got = repeats.merged_blocks(shards, depth)
        classes = {}
        for symbols, numbers in zip(whole, got):
            for i in range(len(symbols)):
                first = symbols[i : i + depth]
                if len(first) == depth and (first >= 10).all():
                    classes.setdefault(tuple(first.tolist()), set()).add(int(numbers[i]))
        assert all(len(v) == 1 for v in classes.values()) and len({min(v) for v in classes.values()}) == len(classes)


def test_transforms_decide_all(spark, monkeypatch):
    """Without the merged transforms nothing is removed, copies of whole texts included; keys dealt by further keys give the same parts."""
    rows = [(i, llm_cases.prose(70, 90)) for i in range(3)] + [(9, llm_cases.prose(71, 60) + llm_cases.prose(70, 90)[40:400])]
    docs = llm_cases.documents(spark, rows)
    assert measured(repeats.remove_repeats(docs)) == repeated(rows) and "0, 0," not in str(measured(repeats.remove_repeats(docs))[0])
    monkeypatch.setattr(repeats, "_compare", lambda contexts, window, flush: contexts.select("key", "same", "lo", F.lit(0).cast("long").alias("hi")).limit(0))
    assert repeats.remove_repeats(docs).agg(F.sum(F.size("spans"))).first()[0] == 0


def test_hot_keys_are_dealt(spark):
    """One gram in very many different texts: its contexts are dealt to many parts, and the result stays exact."""
    gram = "the very common passage of thirty two bytes and some more of it"
    rows = [(i, llm_cases.prose(900 + i, 30) + gram + llm_cases.prose(950 + i % 40, 40)) for i in range(60)]
    docs = llm_cases.documents(spark, rows)
    for levels in (0, 1, 4):
        data = docs.select("doc_id", F.col("text").cast("binary").alias("data")).withColumn("k", F.xxhash64("doc_id", "data", F.octet_length("data")))
        spans = repeats.repeated_spans(data.select("k", "data"), repeats.Scratch(spark, "test"), dense=3, levels=levels)
        got = data.join(spans, "k", "left").select("doc_id", "data", "spans").mapInArrow(repeats._without, "doc_id long, n_bytes long, spans array<struct<s:bigint,e:bigint>>, kept binary")
        assert measured(got) == repeated(rows)
