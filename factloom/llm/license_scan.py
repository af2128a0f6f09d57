"""License scans as an exact set-similarity join, in DataFrame operations only.

A text is cut into blocks of ``block_words`` words that overlap by half. A block
holds a template if it has at most ``1 - threshold`` of the template's distinct
words missing. The join finds every such pair: words are ordered by how many
documents hold them, rarest first, and

- prefix filter: a block that holds ``need`` of a template's n words has one of
  its n - need + 1 rarest;
- length filter: it has ``need`` words of the templates' vocabulary at least;
- positional filter: from the first common word on, both sides have ``need``
  words left;

what passes is verified by intersecting the sets.
"""

from __future__ import annotations

import math
import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.scratch import Scratch

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrase, label.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("public-domain", "This work has been dedicated to the public domain by waiving all rights"),
)


_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def license_words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def template_sets(templates=TEMPLATES) -> dict[str, set[str]]:
    return {name: set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(_LOWER))) for name, text in templates}


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _phrase_starts(w: Column, joined: Column, phrase: str) -> Column:
    """Word numbers at which the phrase stands; looked for only where the joined words hold it."""
    parts = phrase.split(" ")

    def stands(i: Column) -> Column:
        ok = F.get(w, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            ok = ok & F.coalesce(F.get(w, i + k) == p, F.lit(False))
        return ok

    return F.when(joined.contains(f" {phrase} "), F.filter(F.sequence(F.lit(0), F.size(w) - 1), stands)).otherwise(F.array().cast("array<int>"))


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Number of documents with each word of the templates: as many rows as the templates have words, whatever the input."""
    held = docs.select(F.explode(F.array_intersect(license_words(F.col("text")), _strings(vocabulary))).alias("word"))
    return {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}


def template_matches(blocks: DataFrame, sets: dict[str, list[str]], threshold: float) -> DataFrame:
    """The join. blocks: columns to keep and ``tokens``, distinct words of the vocabulary in the global order; adds template, containment."""
    rows = []
    for name, ordered in sets.items():
        need = max(1, math.ceil(threshold * len(ordered) - 1e-9))
        for pos, word in enumerate(ordered[: len(ordered) - need + 1]):
            rows.append(F.struct(F.lit(word).alias("token"), F.lit(name).alias("template"), F.lit(pos).alias("pos"), F.lit(need).alias("need"), _strings(ordered).alias("words")))
    if not rows:
        rows = [F.struct(F.lit(None).cast("string").alias("token"), F.lit("").alias("template"), F.lit(0).alias("pos"), F.lit(1).alias("need"), _strings([]).alias("words"))]
    index = F.broadcast(blocks.sparkSession.range(1).select(F.inline(F.array(*rows))))  # the templates are constants
    keep = [c for c in blocks.columns if c != "tokens"]
    asked = blocks.select(*keep, "tokens", F.posexplode("tokens").alias("at", "token"))
    met = asked.join(index, "token").filter(
        (F.size("tokens") >= F.col("need")) & (F.least(F.size("words") - F.col("pos"), F.size("tokens") - F.col("at")) >= F.col("need"))
    )
    met = met.withColumn("common", F.size(F.array_intersect("tokens", "words"))).filter(F.col("common") >= F.col("need"))
    return met.select(*keep, "template", (F.col("common") / F.size("words")).alias("containment")).distinct()


def scan(docs: DataFrame, *, threshold: float = 0.8, block_words: int = 64, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score.

    docs: doc_id, text; other columns aren't read. score is 1 where a phrase
    stands, else the best containment of a template, else 0. Defined results:
    NULL and empty texts have no words, labels or score; repeated rows give
    repeated results; a NULL doc_id is an id like any other; an empty table gives
    an empty result. A passage of up to half a block's words is whole in one block.
    """
    scratch = Scratch(docs.sparkSession, "license")
    docs = docs.select("doc_id", "text")
    sets = template_sets(templates)
    vocabulary = sorted(set().union(*sets.values())) if sets else []
    df = document_frequencies(docs, vocabulary) if vocabulary else {}
    order = sorted(vocabulary, key=lambda x: (df.get(x, 0), x))
    rank = {x: i for i, x in enumerate(order)}
    ordered = {name: sorted(s, key=rank.get) for name, s in sets.items()}
    prefix = sorted({x for s in ordered.values() for x in s[: len(s) - max(1, math.ceil(threshold * len(s) - 1e-9)) + 1]})
    w, step = F.col("_w"), max(1, block_words // 2)
    base = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), license_words(F.col("text")).alias("_w"))
    base = base.withColumn("_j", F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" ")))
    # blocks keep the vocabulary's words only, in the global order
    tokens = lambda i: F.array_intersect(_strings(order), F.slice(w, i + 1, block_words))
    blocks = F.filter(F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(step)), tokens), lambda b: F.arrays_overlap(b, _strings(prefix)))
    base = base.select(
        "doc_id", "key", F.size(w).cast("long").alias("n_words"),
        *[_phrase_starts(w, F.col("_j"), p).alias(f"_p{i}") for i, (p, _) in enumerate(phrases)],
        F.when(F.arrays_overlap(w, _strings(prefix)), F.array_distinct(blocks)).alias("_blocks"),
    )
    at = F.concat(*[F.col(f"_p{i}") for i in range(len(phrases))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"_p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)]))
    base = scratch.table(base.select(
        "doc_id", "key", "n_words", F.size(at).cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        labels.alias("base_labels"), "_blocks",
    ))
    asked = base.filter(F.size("_blocks") > 0).select("doc_id", "key", F.explode("_blocks").alias("tokens"))
    found = template_matches(asked, ordered, threshold).groupBy("doc_id", "key").agg(F.collect_set("template").alias("_found"), F.max("containment").alias("_best"))
    found = found.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "_found", "_best")
    out = base.join(found, base.doc_id.eqNullSafe(F.col("_d")) & (base.key == F.col("_k")), "left")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.sort_array(F.array_distinct("base_labels")).alias("base_labels"),
        F.sort_array(F.array_distinct(F.concat("base_labels", F.coalesce("_found", F.array().cast("array<string>"))))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )
