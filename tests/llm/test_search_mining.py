"""Collocations and ranked search against plain versions."""

import math
import random
import re
from collections import Counter

import pytest
from llm_cases import documents, empty, texts

from factloom.llm import collocations, ranked_search


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def _mined(rows, max_n=4, least=30, cover=80, top=2000):
    """rows: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", _lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, max_n + 1):
                    if i + m <= len(words):
                        f[lang, tuple(words[i : i + m])] += 1
    held = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, p), a in held.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inside[lang, p[i : i + m]] = max(inside[lang, p[i : i + m]], a)
    out = []
    for lang in n:
        own = []
        for (x, p), a in held.items():
            if x == lang and not (inside[x, p] and 100 * inside[x, p] >= cover * a):
                score, _, left, right = min((2_000_000 * a // (f[x, p[:k]] + f[x, p[k:]]), k, f[x, p[:k]], f[x, p[k:]]) for k in range(1, len(p)))
                own.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -score) for r, (score, a, p, left, right) in enumerate(sorted(own)[:top], 1)]
    return sorted(out)


def _chatter(seed, n):
    r = random.Random(seed)
    words = ["the", "The", "of", "in", "é", "日本", "alpha", "beta", "gamma", *[f"w{i}" for i in range(30)]]
    out = []
    while len(out) < n:
        out += r.choice([["new", "york", "city", "hall"], ["new", "york"], ["of", "the"], [r.choice(words)], [r.choice(words)], [r.choice(words) + r.choice(".,;\n")]])
    return r.choice([" ", "\t", "  "]).join(out)


@pytest.mark.parametrize("options", [{}, {"chunk_words": 50, "part_rows": 7}, {"max_n": 2}, {"max_n": 6, "chunk_words": 300, "part_rows": 40, "cover": 50}, {"top": 3}])
def test_collocations_as_counted_plainly(spark, options):
    rows = [(("en", "fr", None, "und")[i % 4], _chatter(i, 120)) for i in range(24)] + [("en", None), ("fr", ""), (None, " \t\n"), ("en", "new york " * 200), ("en", "x" * 5000)]
    docs = spark.createDataFrame([(lang, t, i, "x") for i, (lang, t) in enumerate(rows)], "lang string, text string, words long, score string")
    plain = {k: v for k, v in options.items() if k not in ("chunk_words", "part_rows")}
    got = collocations.mine(docs, least=4, **options)
    assert sorted(tuple(r) for r in got.collect()) == _mined(rows, least=4, **plain)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations_of_odd_tables(spark):
    rows = texts()
    docs = documents(spark, rows)
    expected = _mined([(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()], least=3)
    assert sorted(tuple(r) for r in collocations.mine(docs, least=3).collect()) == expected
    assert collocations.mine(empty(spark)).collect() == []


def test_slices_join(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 7)
    monkeypatch.setattr(ranked_search, "SLICE", 7)
    names = []
    numbers = collocations._Numbers("en", names)
    text = "One two, three one two four. Five six seven eight nine"
    got = [x for part in collocations.numbered(text.encode(), numbers) for x in part.tolist()]
    assert " ".join(names[i - 1][1].decode() if i else "|" for i in got) == "one two | three one two four | five six seven eight nine"
    assert [w.decode() for part in ranked_search.split_terms(text.encode()) for w in part] == re.findall("[a-z]+", text.lower())


def test_stack_counts_prefixes():
    import numpy as np

    r = random.Random(8)
    rows = sorted({tuple(r.randrange(1, 4) if j < d else 0 for j in range(4)) for d in (2, 3, 4) for _ in range(40)}, reverse=True)
    counts = [r.randrange(1, 5) for _ in rows]
    expected = Counter()
    for row, c in zip(rows, counts, strict=True):
        for m in range(2, 5):
            if row[m - 1]:
                expected[row[:m]] += c
    got = {rows[i][:m]: n for i, m, n in collocations.count_prefixes(np.array(rows, np.uint64), np.array(counts), 3, np.array([int(r[0] == 2) + (r[:2] == (2, 3)) for r in rows]))}
    assert got == {k: v for k, v in expected.items() if v >= 3 or k == (2, 3)}


def _ranked(docs, items, k=50):
    """docs: (doc_id, text), items: (item_id, text)."""
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    held = [(i, Counter(re.findall(pattern, _lower(t)))) for i, t in docs]
    n, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(re.findall(pattern, _lower(t)))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"k": 3}, {"k": 2, "block_terms": 5}, {"k": 1}])
def test_search_as_scored_plainly(spark, options):
    rows = texts() + [(100 + i, _chatter(i, 40 + i)) for i in range(60)]
    items = [(0, "the w1 w2 w3"), (1, "Zoë new york"), (2, None), (3, ""), (4, "nowhere"), (None, "city hall"), (5, rows[0][1]), (1, "hall w5 w5"), (6, "THE of in"), (7, "日本 é")]
    asked = spark.createDataFrame([(i, t, 1, None) for i, t in items], "item_id long, text string, doc_id long, score string")
    got = ranked_search.search(documents(spark, rows), asked, **options).collect()
    assert sorted((tuple(r) for r in got), key=repr) == _ranked(rows, items, options.get("k", 50))


def test_search_of_empty_tables(spark):
    asked = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert ranked_search.search(empty(spark), asked).collect() == []
    assert ranked_search.search(documents(spark), asked.limit(0)).collect() == []


def test_suffix_of_terms_makes_no_candidates():
    import numpy as np

    kth, most = np.array([90, 10, 0, 5]), np.array([100, 30, 40, 15])
    p = ranked_search.plan([np.array([0, 1, 2, 3]), np.array([1, 3])], kth, most)
    assert p.threshold.tolist() == [90, 10]
    assert p.rest.tolist() == [85, 0]  # 15 + 30 + 40 stay below 90; 15 doesn't stay below 10
    assert [p.lead_items[p.lead_at[t] : p.lead_at[t + 1]].tolist() for t in range(4)] == [[0], [1], [], [1]]
