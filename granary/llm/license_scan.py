"""License scan: TF-IDF cosine of headers and licence files to templates, then inheritance.

Every line of every text is looked at. A line with at least two different template words that
are no function words is a candidate; it is scored alone and together with the candidate lines
next to it (a header), by the cosine of its sparse TF-IDF vector to each template's. So are runs
of words of about a template's length, wherever they begin in a line and across lines, so that a
notice is found among other words. Every whole
text is scored by the notices and by the full texts in `licenses`, with the words of both; one
that is close enough is a licence file and licenses its directory. A
document without a header takes the license of the nearest directory above it that has one,
found by joins of distinct directories with their ancestors.

Weights are term frequency times inverse document frequency, for all words alike, template words
too. Words are known by hash; their documents are counted in an aggregate over all texts. A word
that makes up less than a share of one in COMMON of all (word, document) pairs weighs as one that
makes up that share. The share does not depend on the size of the table, so cosines mean the same
on a small and on a large one, and fewer than COMMON words lie above it, which reach the driver and
are broadcast. Where there are fewer pairs than COMMON, every word has its own weight.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm import _text
from granary.llm._joins import spread_join
from granary.llm._store import written

HEADER_COSINE, FILE_COSINE = 0.6, 0.75
#: Words of a smaller part of all (word, document) pairs than one in COMMON weigh alike.
COMMON = 1 << 18
#: Whole texts are scored in blocks of so many, which bounds their matrix of counts.
FILE_BLOCK = 128

#: Notices by which works name their license. A parameter of the operator.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "This software is licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
]


@cache
def full_texts() -> list[tuple[str, str]]:
    """The license texts of the folder `licenses`; what follows ~ in a file's name tells variants apart."""
    found = sorted((f.name, f.read_text("utf-8")) for f in (resources.files("granary.llm") / "licenses").iterdir() if f.name.endswith(".txt"))
    return [(name.removesuffix(".txt").split("~")[0], text) for name, text in found]


#: Function words; they weigh as others do but make no line a candidate.
FUNCTION_WORDS = frozenset("a an and any are as at be by can for free from in is it may not of on or person that the this to under use with you".split())

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


class Vocabulary:
    """The words of the templates, found by hash in flat buffers."""

    def __init__(self, templates: list[tuple[str, str]]) -> None:
        self.words = sorted({w for _, text in templates for w in template_words(text)})
        raw = [w.encode() for w in self.words]
        ends = np.cumsum([len(x) for x in raw])
        keys = _text.span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(x) for x in raw], ends)
        order = np.argsort(keys)
        self.keys, self.numbers = keys[order], order
        self.coarse = np.zeros(1 << 16, bool)
        self.coarse[(keys >> np.uint64(48)).astype(np.int64)] = True
        self.telling = np.array([w not in FUNCTION_WORDS for w in self.words])

    def numbers_in(self, other: Vocabulary) -> np.ndarray:
        """The other vocabulary's number of every word, -1 for words it has not; then one more -1,
        for the number -1 of other words."""
        number = {w: i for i, w in enumerate(other.words)}
        return np.array([number.get(w, -1) for w in self.words] + [-1])

    def hashes(self) -> np.ndarray:
        """The hash of every word, by number."""
        out = np.zeros(len(self.words), np.uint64)
        out[self.numbers] = self.keys
        return out

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all words of a buffer, each one's number, -1 for other words, and hash."""
        data = _FOLD[data]
        starts, ends = _text.spans_of(_WORD[data], offsets)
        keys = _text.span_hashes(data, starts, ends)
        out = np.full(len(starts), -1, np.int64)
        likely = np.flatnonzero(self.coarse[(keys >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, keys[likely]), len(self.keys) - 1)
        same = self.keys[at] == keys[likely]
        out[likely[same]] = self.numbers[at[same]]
        return starts, out, keys


class Weights:
    """Inverse document frequencies of words by hash."""

    def __init__(self, total: int, keys: np.ndarray, counts: np.ndarray, least: int) -> None:
        """Documents of the words `keys` (sorted), and `least`, as all others weigh."""
        self.keys, idf = keys, lambda n: np.log((1 + total) / (1 + n)) + 1
        self.values, self.rare = idf(counts.astype(float)), float(idf(float(least)))
        self.coarse = np.zeros(1 << 20, bool)
        self.coarse[(keys >> np.uint64(44)).astype(np.int64)] = True

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.rare)
        likely = np.flatnonzero(self.coarse[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[likely]), max(0, len(self.keys) - 1))
        same = self.keys[at] == hashes[likely] if len(self.keys) else np.zeros(0, bool)
        out[likely[same]] = self.values[at[same]]
        return out


def document_frequencies(docs: DataFrame) -> Weights:
    """Weights from the numbers of documents that hold each word."""
    schema = T.StructType([T.StructField("word", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            words, at = np.unique(np.concatenate([w for w, _ in kept]), return_inverse=True)
            return words, np.bincount(at, np.concatenate([n for _, n in kept]), len(words)).astype(np.int64)

        batch = lambda words, n: pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])
        held, merged = 0, 0
        for _, data, at in _text.slices(batches, "text"):
            folded = _FOLD[data]
            starts, ends = _text.spans_of(_WORD[folded], at)
            keys, row = _text.span_hashes(folded, starts, ends), np.searchsorted(at, starts, "right") - 1
            order = np.lexsort((row, keys))
            keys, row = keys[order], row[order]
            once = np.ones(len(keys), bool)
            once[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
            words, n = np.unique(keys[once], return_counts=True)
            kept.append((words, n))
            held += len(words)
            if held > 1_000_000 + merged:
                kept[:] = [summed()]
                held = merged = len(kept[0][0])
                if merged > 2_000_000:
                    yield batch(*kept.pop())
                    held = merged = 0
        if kept:
            yield batch(*summed())

    counted = written(docs.select("text").mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    least = (counted.agg(F.sum("n")).first()[0] or 0) // COMMON
    found = counted.where(F.col("n") > least).toArrow()  # fewer than COMMON words, as each has over a COMMON-th of all pairs
    keys, n = found.column("word").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(keys)
    return Weights(docs.count(), keys[order], n[order], least)


class Scorer:
    """Cosines of bags of words to the templates."""

    def __init__(self, templates: list[tuple[str, str]], weights: Weights) -> None:
        self.vocabulary = Vocabulary(templates)
        number = {w: i for i, w in enumerate(self.vocabulary.words)}
        self.idf = weights.of(self.vocabulary.hashes())
        self.names = [name for name, _ in templates]
        self.lengths = [len(template_words(text)) for _, text in templates]
        self.templates = np.zeros((len(templates), len(number)))
        for i, (_, text) in enumerate(templates):
            for w in template_words(text):
                self.templates[i, number[w]] += self.idf[number[w]]
        self.templates /= np.linalg.norm(self.templates, axis=1, keepdims=True)

    def best(self, counts: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of bags (counts of template words, squared norm of the other words' weights): the
        closest template, the first on a tie, and its cosine."""
        weights = counts * self.idf
        norms = np.sqrt((weights**2).sum(axis=1) + others)
        scores = weights @ self.templates.T / np.maximum(norms, 1e-300)[:, None]
        at = scores.argmax(axis=1)
        return at, np.round(scores[np.arange(len(at)), at], 9)


class Bag:
    """The words of a slice: number of each in a vocabulary (-1: none), hash and weight."""

    def __init__(self, words: np.ndarray, hashes: np.ndarray, idf: np.ndarray) -> None:
        self.words, self.hashes, self.idf = words, hashes, idf

    def take(self, at: np.ndarray | slice) -> Bag:
        return Bag(self.words[at], self.hashes[at], self.idf[at])

    def grouped(self, groups: np.ndarray, count: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Bags of words by group: counts of the `size` template words, and the squared norm of
        the other words' weights, frequency times idf."""
        inside = self.words >= 0
        flat = np.bincount(groups[inside] * size + self.words[inside], minlength=count * size)
        own, keys, idf = groups[~inside], self.hashes[~inside], self.idf[~inside]
        order = np.lexsort((keys, own))
        own, keys, idf = own[order], keys[order], idf[order]
        first = np.ones(len(own), bool)
        first[1:] = (own[1:] != own[:-1]) | (keys[1:] != keys[:-1])
        at = np.flatnonzero(first)
        frequency = np.diff(np.append(at, len(own)))
        return flat.reshape(count, size), np.bincount(own[at], (frequency * idf[at]) ** 2, count)


def keep_best(header: list[tuple[float, int] | None], owners: np.ndarray, which: np.ndarray, scores: np.ndarray) -> None:
    """Puts the best header of every owner, the first template on a tie, where it is better."""
    some = np.flatnonzero(scores >= HEADER_COSINE)
    some = some[np.lexsort((which[some], -scores[some], owners[some]))]
    for i in some[np.unique(owners[some], return_index=True)[1]].tolist():
        new, old = (float(scores[i]), int(which[i])), header[owners[i]]
        if old is None or (-new[0], new[1]) < (-old[0], old[1]):
            header[owners[i]] = new


def whole_scores(scorer: Scorer, row: np.ndarray, bag: Bag, n: int) -> Iterator[tuple[int, float, int]]:
    """Of n texts, those that are licence files: (text, cosine, template). row: of every word.

    A word that comes twice counts for more in a norm than two words do, so a norm is at least
    that of the weights by place; only texts that could be close enough by that one are scored."""
    size = len(scorer.vocabulary.words)
    ends = np.searchsorted(row, np.arange(n + 1))
    squares = np.concatenate([[0], np.cumsum(bag.idf**2)])[ends]
    for first in range(0, n, FILE_BLOCK):
        last = min(first + FILE_BLOCK, n)
        own = np.arange(ends[first], ends[last])
        inside = own[bag.words[own] >= 0]
        counts = np.bincount((row[inside] - first) * size + bag.words[inside], minlength=(last - first) * size).reshape(-1, size)
        dots = ((counts * scorer.idf) @ scorer.templates.T).max(axis=1)
        texts = first + np.flatnonzero((dots > 0) & (dots >= (FILE_COSINE - 1e-6) * np.sqrt(np.diff(squares[first : last + 1]))))
        if not len(texts):
            continue
        lengths = ends[texts + 1] - ends[texts]
        _, others = bag.take(_text.ragged(ends[texts], lengths)).grouped(np.repeat(np.arange(len(texts)), lengths), len(texts), size)
        which, scores = scorer.best(counts[texts - first], others)
        for i in np.flatnonzero(scores >= FILE_COSINE).tolist():
            yield int(texts[i]), float(scores[i]), int(which[i])


def windows(scorer: Scorer, row: np.ndarray, bag: Bag) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of words that may be as close as HEADER_COSINE to a template of
    about their length (that or half as much again) and begin with a word of it. row: of every word.

    A word that comes twice counts for more in a bag's norm than two words do, so norms by sums
    over places are no larger and no run that is close enough is left out."""
    words = bag.words
    known = np.flatnonzero(words >= 0)
    telling = np.append(scorer.vocabulary.telling, False)
    told = np.concatenate([[0], np.cumsum(telling[words])])
    squares = np.concatenate([[0], np.cumsum(bag.idf**2)])
    row_end = np.searchsorted(row, row[known], "right")
    found = []
    for template, length in zip(scorer.templates, scorer.lengths, strict=True):
        own = np.flatnonzero(template[words[known]] > 0)
        weights = np.concatenate([[0], np.cumsum(np.append(template * scorer.idf, 0)[words])])
        for reach in {length, length + length // 2}:
            first = known[own]
            last = np.minimum(first + reach, row_end[own])
            some = told[last] - told[first] >= 2
            first, last = first[some], last[some]
            near = weights[last] - weights[first] >= (HEADER_COSINE - 1e-6) * np.sqrt(squares[last] - squares[first])
            found.append(first[near] * (len(words) + 1) + last[near])
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both // (len(words) + 1), both % (len(words) + 1)


_SCANNED = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("path", T.StringType()), T.StructField("header_license", T.StringType()), T.StructField("header_score", T.DoubleType()), T.StructField("n_headers", T.LongType()), T.StructField("file_license", T.StringType()), T.StructField("file_score", T.DoubleType())]
)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """For every row of (doc_id, path, text): the best header's license and cosine, the number of
    lines that are headers or hold one, and, of a licence file, its license and cosine. Null texts
    have none."""
    files = templates + full_texts()
    weights = document_frequencies(docs)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        whole, scorer = Scorer(files, weights), Scorer(templates, weights)
        to_notice = whole.vocabulary.numbers_in(scorer.vocabulary)
        telling, size = scorer.vocabulary.telling, len(scorer.vocabulary.words)
        for rows, data, at in _text.slices(batches, "text"):
            n = rows.num_rows
            starts, file_words, hashes = whole.vocabulary.find(data, at)
            file_bag = Bag(file_words, hashes, weights.of(hashes))
            words = to_notice[file_words]
            bag = Bag(words, hashes, file_bag.idf)
            breaks = np.zeros(len(data) + 1, np.int64)
            np.cumsum(data == 0x0A, out=breaks[1:])
            row = np.searchsorted(at, starts, "right") - 1
            line = breaks[starts] + row  # numbered over rows, a row's end counting as a line's
            first_line = breaks[at[:-1]] + np.arange(n)
            known = np.flatnonzero(words >= 0)
            pairs = np.unique(line[known[telling[words[known]]]] * size + words[known[telling[words[known]]]])
            lines, different = np.unique(pairs // size, return_counts=True)
            lines = lines[different >= 2]
            header: list[tuple[float, int] | None] = [None] * n
            file: list[tuple[float, int] | None] = [None] * n
            of_headers = [lines[:0]]
            if len(lines):
                owner = np.searchsorted(first_line, lines, "right") - 1
                joined = (lines[1:] == lines[:-1] + 1) & (owner[1:] == owner[:-1])
                block = np.concatenate([[0], np.cumsum(~joined)])
                of_line = np.searchsorted(lines, line)
                own = np.flatnonzero(lines[np.minimum(of_line, len(lines) - 1)] == line)
                which, scores = scorer.best(*bag.take(own).grouped(of_line[own], len(lines), size))
                keep_best(header, owner, which, scores)
                of_headers.append(lines[scores >= HEADER_COSINE])
                blocks = int(block[-1]) + 1
                if blocks < len(lines):
                    which, scores = scorer.best(*bag.take(own).grouped(block[of_line[own]], blocks, size))
                    keep_best(header, owner[np.searchsorted(block, np.arange(blocks))], which, scores)
            begin, end = windows(scorer, row, bag)
            for first in range(0, len(begin), 4096):
                start, length = begin[first : first + 4096], (end - begin)[first : first + 4096]
                counts, others = bag.take(_text.ragged(start, length)).grouped(np.repeat(np.arange(len(start)), length), len(start), size)
                which, scores = scorer.best(counts, others)
                scores[(counts[:, telling] > 0).sum(axis=1) < 2] = 0
                keep_best(header, row[start], which, scores)
                own_line = line[start] == line[start + length - 1]
                of_headers.append(line[start[own_line & (scores >= HEADER_COSINE)]])
            n_headers = np.bincount(np.searchsorted(first_line, np.unique(np.concatenate(of_headers)), "right") - 1, minlength=n)
            for i, score, which in whole_scores(whole, row, file_bag, n):
                file[i] = (score, which)
            name = lambda found: pa.array([whole.names[x[1]] if x else None for x in found], pa.string())
            score = lambda found: pa.array([x[0] if x else None for x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([_text.column(rows, "doc_id"), _text.column(rows, "path"), name(header), score(header), pa.array(n_headers), name(file), score(file)], names=_SCANNED.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), "text").mapInArrow(run, _SCANNED)


def _parent(path: F.Column) -> F.Column:
    """The directory of a path, without a slash at the end; '' at the top."""
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*\z", ""), r"/+\z", "")


def licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Every row of (doc_id, path, text) with its scan, `license` and `license_from`: 'header',
    'file', the directory it is inherited from, or null. Where a directory has several licence
    files, the highest cosine holds, then the least license name. Of templates that are equally
    close the first holds.

    Null and empty texts have no license of their own and may inherit one. Without a path nothing
    is inherited. Rows that repeat a doc_id or a path are rows like others. Texts are read whole.
    Other columns are ignored; an empty table gives an empty result. A directory that holds a
    great part of the rows, and the top one, are broadcast in the joins (`_joins`)."""
    scanned = written(scan(docs, templates).withColumn("dir", _parent(F.col("path"))), "licenses")
    own = scanned.where(F.col("file_license").isNotNull() & F.col("dir").isNotNull()).groupBy("dir", "file_license").agg(F.max("file_score").alias("score"))
    licensed = own.groupBy(F.col("dir").alias("above")).agg(F.min_by("file_license", F.struct(-F.col("score"), "file_license")).alias("dir_license"))
    dirs = written(scanned.where(F.col("dir").isNotNull()).groupBy("dir").agg(F.count("*").alias("held")), "directories")
    parts = F.split("dir", "/")
    depths = F.sequence(F.lit(0), F.when(F.col("dir") == "", F.lit(0)).otherwise(F.size(parts)))
    climbs = dirs.withColumn("depth", F.explode(depths)).select("dir", "depth", F.when(F.col("depth") == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest("depth", F.lit(1))), "/")).alias("above"))
    above = written(climbs.groupBy("above").agg(F.count("*").alias("below")).join(licensed, "above"), "licensed-directories")
    reached = spread_join(climbs, above, ["above"], "below", dirs.count())
    nearest = written(dirs.join(reached.groupBy("dir").agg(F.max_by(F.struct("above", "dir_license"), "depth").alias("found")), "dir", "left"), "nearest")
    placed = spread_join(scanned.where(F.col("dir").isNotNull()), nearest, ["dir"], "held", scanned.count())
    out = placed.unionByName(scanned.where(F.col("dir").isNull()), allowMissingColumns=True)
    return out.select(
        "doc_id", "path", "header_license", "header_score", "n_headers", "file_license", "file_score",
        F.coalesce("file_license", "header_license", "found.dir_license").alias("license"),
        F.when(F.col("file_license").isNotNull(), "file").when(F.col("header_license").isNotNull(), "header").otherwise(F.col("found.above")).alias("license_from"),
    )
