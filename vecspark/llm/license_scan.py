"""License scan: an exact set-similarity join of a corpus's text blocks with license templates.

A block is a line or, as notices are mostly wrapped, a run of words in a paragraph (consecutive lines that have words)
of at most 1 / ``at_least`` times the template's words; words are those of the scan (lower-cased A-Z, runs of letters,
digits and everything beyond ASCII). A template is found in a block that contains at least ``at_least`` of the
template's distinct words. The join:

1. Words are ordered by their frequency in the whole corpus, rarest first (counted in a first pass for the words of
   the templates; a block's other words can't match and don't take part).
2. Prefix filter: of a template of n words that needs k, at least one of the n - k + 1 rarest must be in the block.
3. Length filter: the block has at least k words. Positional filter: where the first common word stands in both orders
   bounds how many can still follow.
4. What is left is verified on the whole sets. Runs are looked for in paragraphs that as a whole pass these filters,
   and only around words of the prefix.

Beside this, base phrases are counted wherever their words stand consecutively. Templates and phrases are parameters
and their number doesn't grow with the input. Nulls count as empty texts (no words, no labels, score 0).
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm import textscan
from vecspark.session import ship

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Label and notice, from the licenses' public texts.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
WORD = re.compile("[0-9a-z\\x80-\U0010ffff]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def hash_of(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw], dtype=np.int64)
    return textscan.word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)


def scan_words(texts):
    """Word hashes, starts, the number of words before each text, and the batch's bytes."""
    data, at = textscan.buffers(texts)
    starts, ends, first = textscan.spans(data, at, textscan.ALNUM)
    return textscan.word_hashes(data, starts, ends, lower=True), starts, first, data, at


def frequencies(docs: DataFrame, text: str, vocabulary: list[str]) -> dict[str, int]:
    """How often each word of the vocabulary occurs in the whole corpus."""
    keys = hash_of(vocabulary)
    order = np.argsort(keys)
    ordered = keys[order]

    def run(batches):
        total = np.zeros(len(ordered), np.int64)
        for b in batches:
            hashes = scan_words(b.column(0))[0]
            k = np.searchsorted(ordered, hashes).clip(max=len(ordered) - 1)
            total += np.bincount(k[ordered[k] == hashes], minlength=len(ordered))
        yield pa.RecordBatch.from_arrays([pa.array(order.astype(np.int32)), pa.array(total)], ["word", "n"])

    counted = docs.select(docs[text].cast("string").alias("text")).mapInArrow(textscan.lean(run), "word int, n long").groupBy("word").agg(F.sum("n"))
    found = dict(counted.collect())  # one number for each word of the vocabulary
    return {w: found.get(i, 0) for i, w in enumerate(vocabulary)}


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, templates=TEMPLATES, at_least: float = 0.8) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks.

    score is 1 for a base phrase, else the best containment of a template that was found, else 0; n_blocks is the
    number of lines with a template and of paragraphs with one that none of their lines has.
    """
    spark = docs.sparkSession
    ship(spark)
    textscan.limit_batches(spark)
    sets = [(label, sorted(set(words_of(notice)))) for label, notice in templates]
    vocabulary = sorted({w for _, own in sets for w in own})
    often = frequencies(docs, text, vocabulary)
    vocabulary.sort(key=lambda w: (often[w], w))
    rank = {w: k for k, w in enumerate(vocabulary)}
    wanted = []  # label, ranks in order, how many are needed, prefix length, words of a run
    for (label, own), (_, notice) in zip(sets, templates, strict=True):
        ranks = sorted(rank[w] for w in own)
        need = math.ceil(at_least * len(ranks) - 1e-9)
        wanted.append((label, ranks, need, len(ranks) - need + 1, math.ceil(len(words_of(notice)) / at_least - 1e-9)))
    keys = hash_of(vocabulary)
    by_key = np.argsort(keys)
    prefix = sorted({r for _, ranks, _, m, _ in wanted for r in ranks[:m]})
    probes = np.sort(keys[prefix])
    ordered = keys[by_key]

    def ranked(hashes: np.ndarray, known: bool = False) -> np.ndarray:
        """The words' ranks, -1 for words of no template (known: without these)."""
        j = np.searchsorted(ordered, hashes).clip(max=len(ordered) - 1)
        hit = ordered[j] == hashes
        return by_key[j[hit]] if known else np.where(hit, by_key[j], -1)

    base = [(hash_of(phrase.split(" ")), label) for phrase, label in phrases.items()]

    def matches(block: list[int]) -> list[tuple[int, float]]:
        """Templates (their numbers) in a block, given as its words' ranks in order."""
        place = {r: k for k, r in enumerate(block)}
        out = []
        for t, (_, ranks, need, m, _) in enumerate(wanted):
            if len(block) < need:
                continue
            i = next((i for i in range(m) if ranks[i] in place), None)
            if i is None or 1 + min(len(ranks) - i, len(block) - place[ranks[i]]) - 1 < need:
                continue
            shared = sum(r in place for r in ranks)
            if shared >= need:
                out.append((t, shared / len(ranks)))
        return out

    def best_run(words: np.ndarray, t: int) -> float:
        """The best containment of a template in a run of a paragraph's words, given as ranks (-1: none); 0 if too low."""
        _, ranks, need, m, width = wanted[t]
        where = np.flatnonzero(np.isin(words, ranks))
        rare = where[np.isin(words[where], ranks[:m])]
        k = np.searchsorted(rare, where)
        before, after = where - rare[np.maximum(k - 1, 0)], rare[np.minimum(k, len(rare) - 1)] - where
        where = where[((k > 0) & (before < width)) | ((k < len(rare)) & (after < width))]
        own, at = words[where].tolist(), where.tolist()
        count, low, most = dict.fromkeys(ranks, 0), 0, 0
        shared = 0
        for r, place in zip(own, at, strict=True):
            shared += not count[r]
            count[r] += 1
            while at[low] <= place - width:
                count[own[low]] -= 1
                shared -= not count[own[low]]
                low += 1
            most = max(most, shared)
        return most / len(ranks) if most >= need else 0.0

    def run(batches):
        for b in batches:
            hashes, starts, first, data, at = scan_words(b.column(1))
            n = len(first) - 1
            counts, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base_labels: dict[int, set[str]] = {}
            for h, label in base:
                where = np.flatnonzero(hashes[: len(hashes) - len(h) + 1] == h[0]) if len(hashes) >= len(h) else np.zeros(0, np.int64)
                for j in range(1, len(h)):
                    where = where[hashes[where + j] == h[j]]
                doc = np.searchsorted(first, where, side="right") - 1
                good = where + len(h) <= first[doc + 1]
                where, doc = where[good], doc[good]
                np.add.at(counts, doc, 1)
                np.minimum.at(low, doc, where - first[doc])
                np.maximum.at(high, doc, where - first[doc])
                for d in np.unique(doc).tolist():
                    base_labels.setdefault(d, set()).add(label)
            labels = {d: set(found) for d, found in base_labels.items()}
            best, blocks = np.zeros(n), np.zeros(n, np.int64)
            k = np.searchsorted(probes, hashes).clip(max=len(probes) - 1)
            hits = np.flatnonzero(probes[k] == hashes)
            if len(hits):
                breaks = np.union1d(np.flatnonzero((data == 10) | (data == 13)), at)
                lines = np.unique(np.searchsorted(breaks, starts[hits], side="right"))
                bounds = np.append(breaks, len(data) + 1)
                a = np.searchsorted(starts, bounds[lines - 1])
                z = np.searchsorted(starts, bounds[lines])
                owner = np.searchsorted(first, a, side="right") - 1
                in_lines: list[tuple[int, int]] = []  # first word of a line and a template in it
                for x, y, d in zip(a.tolist(), z.tolist(), owner.tolist(), strict=True):
                    found = matches(np.unique(ranked(hashes[x:y], known=True)).tolist())
                    if found:
                        blocks[d] += 1
                        best[d] = max(best[d], *(c for _, c in found))
                        labels.setdefault(d, set()).update(wanted[t][0] for t, _ in found)
                        in_lines += [(x, t) for t, _ in found]
                ends = np.flatnonzero((data == 10) | ((data == 13) & (np.append(data[1:], 0) != 10)))
                line = np.searchsorted(ends, starts)
                edges = np.unique(np.concatenate([first, np.flatnonzero(np.diff(line) > 1) + 1]))
                paragraphs = np.unique(np.searchsorted(edges, hits, side="right"))
                a, z = edges[paragraphs - 1], edges[paragraphs]
                several = line[z - 1] > line[a]
                a, z = a[several], z[several]
                owner = np.searchsorted(first, a, side="right") - 1
                line_at = np.array([x for x, _ in in_lines], np.int64)
                for x, y, d in zip(a.tolist(), z.tolist(), owner.tolist(), strict=True):
                    words = ranked(hashes[x:y])
                    found = [(t, c) for t, _ in matches(np.unique(words[words >= 0]).tolist()) if (c := best_run(words, t))]
                    if found:
                        seen = {t for _, t in in_lines[np.searchsorted(line_at, x) : np.searchsorted(line_at, y)]}
                        blocks[d] += any(t not in seen for t, _ in found)
                        best[d] = max(best[d], *(c for _, c in found))
                        labels.setdefault(d, set()).update(wanted[t][0] for t, _ in found)
            none = counts == 0
            text_of = lambda table: pa.array([",".join(sorted(table.get(d, ()))) for d in range(n)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(first)), pa.array(counts), pa.array(low, pa.int64(), mask=none), pa.array(high, pa.int64(), mask=none), text_of(base_labels), text_of(labels), pa.array(np.where(none, best, 1.0)), pa.array(blocks)],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_blocks"],
            )

    picked = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return picked.mapInArrow(textscan.lean(run), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long")
