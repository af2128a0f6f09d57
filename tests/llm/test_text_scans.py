"""Quality rules, secret scans and license scans against plain Python."""

import hashlib
import math
import re
from collections import Counter

import llm_cases
import pytest
from pyspark.sql import functions as F

from factloom.llm import license_scan, quality_rules, secret_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, lang string")


def signals(t):
    w = WORD.findall(t or "")
    windows = list(zip(w, w[1:], w[2:]))
    count, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_signals(spark):
    docs = llm_cases.documents(spark)
    got = quality_rules.apply_rules(docs, labels(spark, [(0, 1, 0, "en"), (None, 1, 0, None), (4, None, 0, None)])).collect()
    want = sorted(((i is None, i or 0), signals(t)) for i, t in llm_cases.texts())
    assert sorted(((r.doc_id is None, r.doc_id or 0), tuple(r[1:6])) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed)


def test_quality_of_nothing(spark):
    assert quality_rules.apply_rules(llm_cases.empty(spark), labels(spark, [(0, 1, 0, "en")])).count() == 0
    assert quality_rules.apply_rules(llm_cases.documents(spark), labels(spark, []).limit(0)).count() == len(llm_cases.texts())


@pytest.mark.parametrize("n, k, p", [(1, 0, 0.01), (500, 2, 0.01), (1000, 30, 0.05), (20_000, 150, 0.01), (300_000, 2900, 0.01)])
def test_binomial_bound_is_exact(spark, n, k, p):
    got = spark.range(1).select(quality_rules.binomial_cdf(f"cast({n} as bigint)", f"cast({k} as bigint)", p).alias("x")).first().x
    want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
    assert got == pytest.approx(want, rel=1e-6)


def test_cutoffs_spare_good_documents(spark):
    rows = [(i, "en", 0.001 * (i % 50) if i % 200 else 9.0) for i in range(6000)] + [(i, "few", 0.0) for i in range(20)]
    rule = quality_rules.Rule("x", "x", (20.0, 5.0, 1.0, 0.04, 0.02))
    held = spark.createDataFrame(rows, "doc_id long, stratum string, x double").withColumn("good", F.lit(True))
    got = {r.stratum: r for r in quality_rules.choose_cutoffs(held, "stratum", "good", 0.02, 0.05, (rule,)).collect()}
    assert set(got) == {"en"}  # 20 documents can't show so low a share
    assert got["en"].cutoff == 1.0 and got["en"].n_rejected == 30 and got["en"].bound <= 0.05 / 2


def test_keep_good_agrees_and_keeps_columns(spark):
    docs, marks = llm_cases.documents(spark), labels(spark, [(0, 1, 0, "en")])
    kept = quality_rules.keep_good(docs, marks)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((r.doc_id is None, r.doc_id or 0) for r in quality_rules.apply_rules(docs, marks).collect() if r.kept)


KINDS = {"assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6), "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20), "hex": (re.compile("[0-9a-f]+"), 0, 24)}
SECRETS = [
    (1, "token: token: abcdefg password = 'hunter2x' é API_KEY=ABCDEF012345 secret=short"), (2, "AKIA" + "A1" * 9 + " and AKIAAKIA" + "Z" * 8 + " deadbeef" * 3 + "0123456789abcdef" * 2), (3, None), (4, ""),
    (5, "username=alice " + "x " * 20 + "pwd=abcdefgh"), (6, "username=alice " + "x " * 200 + "pwd=abcdefgh"), (7, "postgres://db.example:5432/x username: bob auth=Zm9vYmFy1"), (7, "pwd=abcdefgh"),
    (None, "see https://example.org/a pwd=topsecret9"), (8, "token=" + "a" * 3000), (9, "日本 passwd=日本 passwd=abcdef"), (10, "password=password=abcdef"), (10, "password=password=abcdef"),
]


def base_spans(t):
    spans = []
    for n, (kind, (p, group, least)) in enumerate(KINDS.items()):
        spans += [(m.start(), n, m.end(), kind) for m in p.finditer(t or "") if len(m[group]) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, n, b, k in sorted(spans))


def test_secrets_base(spark):
    got = secret_scan.digest(secret_scan.scan(llm_cases.documents(spark, SECRETS))).collect()
    key = lambda i, h: (i is None, i or 0, h)
    assert sorted(key(r.doc_id, r.base_sha256) for r in got) == sorted(key(i, hashlib.sha256(base_spans(t).encode()).hexdigest()) for i, t in SECRETS)


def test_weak_parts_need_complements(spark):
    got = {(r.doc_id, r.key): sorted(x["kind"] for x in r.linked) for r in secret_scan.scan(llm_cases.documents(spark, SECRETS)).collect()}
    by = {}
    for (i, _), kinds in got.items():
        by.setdefault(i, []).append(kinds)
    assert by[5] == [["linked_id", "linked_secret"]] and by[6] == [[]]
    assert sorted(by[7]) == [[], ["linked_endpoint", "linked_id", "linked_secret"]]
    assert by[None] == [["linked_secret"]]  # an endpoint alone completes a secret, but isn't reported without an id


def test_weak_parts_in_either_case(spark):
    lower = "user=alice auth=abc123xyz https://host.example/x"
    docs = llm_cases.documents(spark, [(1, lower), (2, lower.replace("user", "USER").replace("auth", "Auth").replace("https", "HTTPS"))])
    got = {r.doc_id: sorted((x.s, x.e, x.kind) for x in r.linked) for r in secret_scan.scan(docs).collect()}
    assert len(got[1]) == 3 and got[2] == got[1]



def test_redaction(spark):
    docs = llm_cases.documents(spark, SECRETS)
    got = secret_scan.redact_secrets(docs)
    assert got.columns == docs.columns and got.count() == len(SECRETS)
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[9].text == "日本 passwd=日本 [REDACTED]" and rows[9].n_chars == len(rows[9].text)
    assert rows[3].text is None and rows[8].text == "[REDACTED]" and rows[6].text == dict(SECRETS)[6]
    assert secret_scan.redact_secrets(llm_cases.empty(spark)).count() == 0


LICENSE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NOTICES = [
    (1, "All Rights Reserved. all rights, reserved! CC BY 4.0"), (2, None), (3, ""), (4, "GENERAL public-license general public general public license"), (5, "cc\nby cc byé"), (6, "Permission is granted, free of charge, to any person obtaining a copy of this software"),
    (7, "x " * 500 + "Licensed under the Apache License, Version 2.0." + " y" * 500), (8, "licensed " + "z " * 80 + "under the apache license version 2 0"), (None, "all rights reserved"), (1, "cc by"), (9, "ALL RIGHTS RESERVEDK"),
]


def license_row(t):
    w = LICENSE.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    at, names = [], set()
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += hits
        names |= {label} if hits else set()
    best = {}
    for i in range(0, len(w), 32):
        block = set(w[i : i + 64])
        for name, words in license_scan.template_sets().items():
            if len(block & words) >= math.ceil(0.8 * len(words) - 1e-9):
                best[name] = max(best.get(name, 0), len(block & words) / len(words))
    score = 1.0 if at else max(best.values(), default=0.0)
    return len(w), len(at), min(at, default=None), max(at, default=None), sorted(names), sorted(names | set(best)), round(score, 9)


def test_licenses_against_all_blocks(spark):
    rows = NOTICES + llm_cases.texts()
    got = license_scan.scan(llm_cases.documents(spark, rows)).collect()
    want = sorted(repr((i, *license_row(t))) for i, t in rows)
    assert sorted(repr((*tuple(r)[:7], round(r.score, 9))) for r in got) == want
    assert any("mit" in w for w in want) and any("apache-2.0" in w for w in want)


def test_licenses_of_nothing(spark):
    assert license_scan.scan(llm_cases.empty(spark)).count() == 0


def test_long_texts_with_many_secrets(spark):
    """300,000 matches in one text of 5 MB, in seconds; overlapping spans, text around them and code points beyond ASCII."""
    import time

    text = "é" + "secret=abcdef x " * 300_000
    docs = llm_cases.documents(spark, [(1, text), (2, "plain")]).checkpoint()
    began = time.time()
    found = secret_scan.digest(secret_scan.scan(docs)).filter("doc_id = 1").first()
    got = secret_scan.redact_secrets(docs).filter("doc_id = 1").first()
    took = time.time() - began
    assert found.n_assign == 300_000
    want = ",".join(f"assign:{1 + 16 * i}:{14 + 16 * i}" for i in range(300_000))
    assert found.spans == want and found.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert got.text == "é" + "[REDACTED] x " * 300_000 and got.n_chars == len(got.text)
    assert took < 60, took


def test_masks_of_any_spans(spark):
    import random

    r = random.Random(4)
    rows = []
    for i in range(60):
        text = "".join(r.choice("abé日🙂 ") for _ in range(r.choice((3, 40, 3000))))
        spans = [(a, min(len(text), a + r.randrange(1, 6)), "x") for a in (r.randrange(len(text)) for _ in range(r.choice((0, 1, 5, 700))))]
        rows.append((i, text, spans))
    got = spark.createDataFrame(rows, f"i long, text string, spans {secret_scan.SPAN}").select("i", secret_scan.redact(F.col("text"), F.col("spans"), "#").alias("t")).collect()
    for x in got:
        _, text, spans = rows[x.i]
        out, at = [], 0
        for a, b, _ in sorted(spans):
            if a >= at:
                out += [text[at:a], "#"]
            at = max(at, b)
        assert x.t == "".join(out) + text[at:]


def test_license_words_lower_ascii_only(spark):
    docs = llm_cases.documents(spark, [(1, "ALL RIGHTS RESERVED K İ All Rights Reserved")])
    got = license_scan.scan(docs).first()
    assert (got.n_words, got.n_base, got.first_word, got.last_word) == (8, 2, 0, 5)
    assert spark.range(1).select(license_scan.license_words(F.lit("Kİ AZ")).alias("w")).first().w == ["Kİ", "az"]
