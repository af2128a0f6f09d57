"""The pipeline against its stages in plain Python."""

import os
import random
from collections import Counter, defaultdict

import llm_cases
import numpy as np
import pytest
from test_duplicates import fingerprint, groups
from test_packing_mixing import WORD, fill, ids_of
from test_text_scans import KINDS, signals

from factloom.llm import near_text

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, llm_cases.prose(i, 60 + i)) for i in range(40)] + [(100 + i, llm_cases.prose(i, 60 + i)) for i in range(5)] + [(200, llm_cases.prose(99, 70) + " password=topsecret123 end")] + llm_cases.texts()
    docs = llm_cases.documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(os.path.join(out, "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(os.path.join(out, "labels.parquet"))
    return out


def masked(t):
    spans = sorted((m.start(), m.end()) for p, group, least in KINDS.values() for m in p.finditer(t) if len(m[group]) >= least)
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += t[at:a] + "[REDACTED]"
        at = max(at, b)
    return out + t[at:]


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r)[:4] for r in docs.collect()]
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        docs = spark.createDataFrame(out.collect(), out.schema)
        results[name] = [tuple(r) for r in docs.collect()]
    # too few labels for a cutoff: the base rules alone reject
    good = [r for r in rows if not ((s := signals(r[1]))[0] < 50 or 100 * s[4] > 50 * s[0])]
    assert Counter(r[:4] for r in results["quality rules"]) == Counter(good)
    fps = [fingerprint(r[1]) for r in good]
    root = groups(len(good), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    heads = defaultdict(list)
    for r, k in zip(good, root):
        heads[k].append(r)
    kept = results["near duplicates"]
    assert len(kept) == len(heads) and sorted(r[0] is None or r[0] for r in kept) == sorted(min((x[0] is None, x[0] or 0) for x in h)[1] if any(x[0] is not None for x in h) else True for h in heads.values())
    assert Counter((r[0], r[1]) for r in results["secrets"]) == Counter((r[0], masked(r[1])) for r in kept)
    assert any("[REDACTED]" in r[1] for r in results["secrets"])
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in results["secrets"]:
        sizes[r[3]] += len(WORD.findall(r[1]))
    for r in results["mixing"]:
        taken[r[3]] += len(WORD.findall(r[1]))
    for s, want in fill(dict(sizes)).items():
        assert abs(taken[s] - want) <= max(1, sizes[s] // 512) + 1
    texts = Counter(np.array(ids_of(r[1]), "<u4").tobytes() for r in results["mixing"])
    assert sum(len(r[4]) for r in results["packing"]) == sum(len(k) * n for k, n in texts.items())
    single = Counter(bytes(r[4]) for r in results["packing"] if len(r[4]) < 4 * 2048)
    assert not single - Counter({k[: len(k) % (4 * 2048) or len(k)] if len(k) > 4 * 2048 else k: n for k, n in texts.items()})


def test_near_copies_of_brute_force_go(spark):
    r = random.Random(8)
    rows = []
    for i in range(60):
        w = llm_cases.prose(500 + i, 150, 4000).split()
        rows.append((1000 * i, " ".join(w)))
        for k in range(1, 4):
            v = list(w)
            for at in r.sample(range(0, 150, 5), r.randrange(1, 6)):
                v[at] = f"new{i}x{k}x{at}"
            rows.append((1000 * i + k, " ".join(v)))
    sets = [{tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    similar = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    root = groups(len(rows), similar)
    near = [(a, b) for a in range(len(rows)) for b in range(a) if similar(a, b)]
    fps = [fingerprint(t) for _, t in rows]
    assert len(near) > 50 and sum((fps[a] ^ fps[b]).bit_count() <= 2 for a, b in near) < len(near) / 2
    docs = llm_cases.documents(spark, rows)
    got = {x.doc_id: x.root for x in near_text.near_copies(docs).collect()}
    assert sum(got[rows[a][0]] == got[rows[b][0]] for a, b in near) >= 0.9 * len(near)
    assert all(got[rows[a][0]] != got[rows[b][0]] for a in range(len(rows)) for b in range(a) if root[a] != root[b])
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert {x.doc_id for x in kept.collect()} == {min(d for d in got if got[d] == k) for k in set(got.values())}


def test_run_is_the_stages_in_a_row(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.count() > 0 and {"sequence_id", "offset", "ids"} <= set(got.columns)


def test_columns_stay_until_the_last_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), folder).columns == docs.columns
