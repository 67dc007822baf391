"""License scans: fixed phrases, and templates found by diagonal voting.

Words are lower-cased runs of ASCII letters, digits and non-ASCII characters.  Base: places where a phrase's words stand
consecutively.  Method: Spark joins every rolling K-word hash of the distinct texts to the templates' positions; a hit
at text word p and template word t votes for diagonal p - t; votes are added up by diagonal, diagonals within
DRIFT of the next one merge (words were put in or left out), and a merged run is verified: the share of the
template's words that its hits cover, and how densely they lie in the span.

Edge cases: null text counts as empty: no words, null first_word and last_word, empty labels, score 0; ids may be null
or repeat, a row each; equal texts are voted on once; texts are scanned whole; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import bounded_batches, cut, small
from .textbatch import NOT_ALNUM, chain, words

K, DRIFT, LEAST_SHARE, LEAST_DENSITY = 4, 8, 0.6, 0.5
BROADCAST_ROWS = 200_000

#: Fixed phrases of the contract and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Fixed texts: public license notices and grants, each with its label.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def _hashes(text: str) -> np.ndarray:
    return next(words(pa.array([text]), NOT_ALNUM)).hash


def template_grams(templates: list[tuple[str, str]]) -> list[tuple[int, int, int]]:
    """(hash, template, position) of every K-word run of the templates."""
    return [(int(h), t, p) for t, (_, text) in enumerate(templates) for p, h in enumerate(chain(_hashes(text), K).view(np.int64))]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # equal texts of a partition are hashed once
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        for w in words(batch.column(1), NOT_ALNUM):
            h = chain(w.hash, K).view(np.int64)
            doc = w.doc[: len(h)]
            inside = np.arange(len(h)) + K <= w.bounds[1:][doc]
            fresh = np.array([k not in seen for k in key[w.lo : w.hi].tolist()], bool)
            if len(seen) < 1_000_000:
                seen.update(key[w.lo : w.hi].tolist())
            inside &= fresh[doc]
            at = np.flatnonzero(inside)
            yield pa.RecordBatch.from_arrays([pa.array(key[w.lo + doc[at]]), pa.array((at - w.bounds[doc[at]]).astype(np.int32)), pa.array(h[at])], names=["key", "pos", "gram"])


def rising(values: list[int]) -> list[int]:
    """Indices of a longest strictly rising subsequence."""
    ends: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(ends, v)
        before[i] = at[k - 1] if k else -1
        ends[k : k + 1], at[k : k + 1] = [v], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _covered(places: np.ndarray) -> int:
    """Words in the K-word pieces at these rising places."""
    return int(np.minimum(K, np.diff(places, append=places[-1] + K)).sum())


def best_run(votes: list[tuple[int, np.ndarray]], n: int) -> tuple[float, int, int]:
    """(share of a template of n words, first and last word) of the best verified run; votes are (diagonal, places), sorted.

    Verified are the hits of one run of the text that follow each other in the template too: pieces in another order don't count.
    """
    best = (0.0, -1, -1)
    groups: list[list[tuple[int, np.ndarray]]] = []
    for d, places in votes:
        if groups and d - groups[-1][-1][0] <= DRIFT:
            groups[-1].append((d, places))
        else:
            groups.append([(d, places)])
    for group in groups:
        pos, own = (np.concatenate(x) for x in zip(*[(p, p - d) for d, p in group]))
        by = np.lexsort((-own, pos))
        pos, own = pos[by], own[by]
        # runs of hits no further apart than the template is long
        for part in np.split(np.arange(len(pos)), np.flatnonzero(np.diff(pos) > n) + 1):
            if len(part) + K - 1 < LEAST_SHARE * n / K:
                continue
            held = part[rising(own[part].tolist())]
            share = _covered(own[held]) / n
            if share >= LEAST_SHARE and share > best[0] and _covered(pos[held]) >= LEAST_DENSITY * (pos[held[-1]] + K - pos[held[0]]):
                best = (share, int(pos[held[0]]), int(pos[held[-1]] + K - 1))
    return best


def _verifier(sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (key, template, diagonal): the votes of one text for one template in memory at a time."""
        at: tuple[int, int] | None = None
        votes: list[tuple[int, np.ndarray]] = []
        out: list[tuple] = []

        def close() -> None:
            if at is not None:
                share, start, end = best_run(votes, sizes[at[1]])
                if share:
                    out.append((*at, share, start, end))

        def rows() -> pa.RecordBatch:
            types = (pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int32())
            cols = list(zip(*out)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["key", "template", "share", "start", "end"])

        for batch in batches:
            key, template, diagonal, places = (batch.column(k) for k in range(4))
            for i, (k, t, d) in enumerate(zip(key.to_pylist(), template.to_pylist(), diagonal.to_pylist())):
                if (k, t) != at:
                    close()
                    at, votes = (k, t), []
                votes.append((d, places[i].values.to_numpy(zero_copy_only=False).astype(np.int64)))
            yield rows()
            out.clear()
        close()
        yield rows()

    return run


def template_spans(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(key, label, share, start, end): verified template spans of each distinct text; key is xxhash64(text)."""
    templates = templates or TEMPLATES
    spark = docs.sparkSession
    known = spark.createDataFrame(template_grams(templates), "gram long, template int, t int")  # one row a template word
    text = docs.select(F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    grams = text.select(F.xxhash64("text").alias("key"), "text").mapInArrow(_grams, "key long, pos int, gram long")
    hits = grams.join(F.broadcast(known), "gram").select("key", "template", "pos", "t").distinct()
    votes = hits.groupBy("key", "template", (F.col("pos") - F.col("t")).alias("diagonal")).agg(F.collect_list("pos").alias("places"))
    sizes = [len(_hashes(x)) for _, x in templates]
    votes = votes.repartition("key", "template").sortWithinPartitions("key", "template", "diagonal")
    spans = votes.mapInArrow(_verifier(sizes), "key long, template int, share double, start int, end int")
    names = F.create_map(*[F.lit(x) for t, (label, _) in enumerate(templates) for x in (t, label)])
    return spans.select("key", F.element_at(names, F.col("template")).alias("label"), "share", "start", "end")


def base_places(text: pa.Array) -> pa.Array:
    """Words, places, first and last place, and labels of the fixed phrases in each text."""
    phrases = [(_hashes(p), label) for p, label in PHRASES.items()]
    n_words, n_base, first, last, labels = [], [], [], [], []
    for w in words(text, NOT_ALNUM):
        size = np.diff(w.bounds)
        n_words += size.tolist()
        starts: list[list[int]] = [[] for _ in size]
        found: list[set[str]] = [set() for _ in size]
        for h, label in phrases:
            m = len(h)
            at = np.flatnonzero(w.hash == h[0])
            for j in range(1, m):
                at = at[at + j < len(w.hash)]
                at = at[w.hash[at + j] == h[j]]
            doc = np.searchsorted(w.bounds, at, "right") - 1
            for a, d in zip(at.tolist(), doc.tolist()):
                if a + m <= w.bounds[d + 1]:
                    starts[d].append(a - int(w.bounds[d]))
                    found[d].add(label)
        n_base += [len(s) for s in starts]
        first += [min(s) if s else None for s in starts]
        last += [max(s) if s else None for s in starts]
        labels += [sorted(f) for f in found]
    return pa.StructArray.from_arrays(
        [pa.array(n_words, pa.int64()), pa.array(n_base, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(labels, pa.list_(pa.string()))],
        names=["n_words", "n_base", "first_word", "last_word", "base"],
    )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of docs(doc_id, text).

    score: 1 where a fixed phrase stands, else the largest verified share of a template.
    """
    bounded_batches(docs.sparkSession)
    look = F.arrow_udf(base_places, "struct<n_words long, n_base long, first_word long, last_word long, base array<string>>")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("_key"), look(text).alias("_b")).select("doc_id", "_key", "_b.*")
    found = cut(template_spans(docs).groupBy("key").agg(F.collect_set("label").alias("_more"), F.max("share").alias("_share")))
    rows = rows.join(small(found, BROADCAST_ROWS), F.col("_key") == F.col("key"), "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("_more", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_share", F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
