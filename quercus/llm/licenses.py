"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory.

Templates are one-line notices, the headers that licences ask for, and the paragraphs of whole licences (quercus/llm/license_texts).
Every run of words of a template's length (and a quarter more, for what was inserted) anywhere in a document is compared
with it: punctuation, line breaks and comment signs make no difference, and nothing is cut off. Weights are inverse document
frequencies in the whole corpus, exact for every word that counts.

* No run of words can reach the cosine unless the document has words that make up its square of the template's length (Cauchy
  and Schwarz): templates that fail that are passed over, which loses nothing.
* For the others, prefix sums give the dot product of all runs, and a bound of their norm in which words that no template has
  weigh 1, the least. Runs whose bound reaches the cosine are candidates.
* Their unknown words are few. One more pass counts in how many documents those occur, and a join gives the exact cosines.

Of candidates that overlap, the one that explains most counts; paragraphs that several licences share speak for the one of which
the document has most. SPDX lines are read as they are. A document most of whose words stand in such passages, or whose name
says so, is a licence file and speaks for its directory. Documents without a licence of their own take that of the nearest
directory above them that has a file; paths are joined level by level over directories, of which there are few, and the
result is joined with the documents by salted directory.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quercus.functions.tables import small_batches
from quercus.llm.common import alone, forget, row_id, utf8, written
from quercus.llm.decontaminate import words_of

#: Whole licences, and what the Affero licence has instead of the plain one's title, preamble and section 13.
TEXTS, AFFERO, PLAIN = Path(__file__).parent / "license_texts", "AGPL-3.0", "GPL-3.0"
#: How notices and headers of well-known licences read.
NOTICES: list[tuple[str, str]] = [
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    ("ISC", "Released under the ISC License"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0"),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    (
        "LGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    ),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0"),
    ("Unlicense", "Released into the public domain under the Unlicense"),
    ("Zlib", "Licensed under the zlib License"),
]
#: Least cosine of a passage; share of a document's words in passages that makes it a licence file; words of a paragraph
#: (shorter ones go with the next); words of a licence that is a template as a whole, too.
COSINE, FILE_SHARE, PARAGRAPH, SHORT = 0.82, 0.5, 40, 400
#: Passages with at most so many words between them are one text; a licence with such a share of its words has all of it.
GAP, MOST = 60, 0.7
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice)(\.[a-z]+)?$"
_SPDX_ID = r"[A-Za-z0-9][A-Za-z0-9.+-]*"
SPDX = re.compile(rf"SPDX-License-Identifier:[ \t]*(\(*{_SPDX_ID}\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*{_SPDX_ID}\)*)*)")
#: Buckets of the filter for unknown words; words that a task counts before it sends them on.
FILTER, HELD = 1 << 20, 100_000
SALTS = 16


@dataclass(frozen=True)
class Template:
    """kind: notice, whole (a licence) or part (a paragraph of one)."""

    names: tuple[str, ...]
    words: tuple[bytes, ...]
    kind: str


def _paragraphs(text: str) -> Iterator[tuple[bytes, ...]]:
    held: list[bytes] = []
    for part in re.split(r"\n[ \t]*\n", text):
        held += words_of(part.encode())
        if len(held) >= PARAGRAPH:
            yield tuple(held)
            held = []
    if held:
        yield tuple(held)


def bodies() -> dict[str, str]:
    """Whole licences by name. The Affero licence is the plain one with its own title, preamble and section 13."""
    found = {p.stem: p.read_text(encoding="utf-8") for p in sorted(TEXTS.glob("*.txt"))}
    own, plain = found.pop(f"{AFFERO}-own"), found[PLAIN]
    before, remote = own.split("  13. ")
    kept = plain[plain.index("  The precise terms") : plain.index("  13. Use with")]
    found[AFFERO] = f"{before}{kept}  13. {remote}\n{plain[plain.index('  14. Revised') : plain.index('                     END OF TERMS')]}"
    return found


def templates() -> list[Template]:
    """Notices, short licences whole, and the paragraphs of all; equal paragraphs are one with several names."""
    out = [Template((name,), tuple(words_of(text.encode())), "notice") for name, text in NOTICES]
    names: dict[tuple[bytes, ...], list[str]] = {}
    for name, text in bodies().items():
        words = tuple(words_of(text.encode()))
        if len(words) <= SHORT:
            out.append(Template((name,), words, "whole"))
        for part in _paragraphs(text):
            of = names.setdefault(part, [])
            if name not in of:
                of.append(name)
    return out + [Template(tuple(sorted(of)), words, "part") for words, of in names.items()]


def _peaks(values: np.ndarray, width: int) -> np.ndarray:
    """Places of the greatest value in each stretch of width values (of equal ones the first)."""
    padded = np.concatenate([values, np.full(-len(values) % width, -np.inf)]).reshape(-1, width)
    return padded.argmax(axis=1) + width * np.arange(len(padded))


class Matcher:
    """Templates as unit vectors over their own words."""

    def __init__(self, frequency: dict[bytes, int], documents: int) -> None:
        self.templates = templates()
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t in self.templates for w in t.words}))}
        size = len(self.vocabulary)
        self.idf = np.array([weight(frequency.get(w, 0), documents) for w in self.vocabulary] + [1.0])
        self.unit = np.zeros((len(self.templates), size + 1))
        for n, t in enumerate(self.templates):
            for w, tf in Counter(t.words).items():
                at = self.vocabulary[w]
                self.unit[n, at] = tf * self.idf[at]
        self.unit /= np.sqrt((self.unit**2).sum(axis=1, keepdims=True))
        self.squares = np.ascontiguousarray((self.unit[:, :size] ** 2).T)
        self.body: dict[str, int] = {}
        for t in self.templates:
            for name in t.names if t.kind == "part" else ():
                self.body[name] = self.body.get(name, 0) + len(t.words)

    def candidates(self, words: list[bytes]) -> list[tuple[int, int, int, float, float, dict[bytes, int]]]:
        """template, first word, words, dot product with the template's unit vector, square of the norm without unknown words, and those with their counts."""
        none = len(self.vocabulary)
        ids = np.fromiter((self.vocabulary.get(w, none) for w in words), dtype=np.int32, count=len(words))
        here = np.unique(ids)
        here = here[here < none]
        if not len(here):
            return []
        out = []
        able = np.nonzero(self.squares[here].sum(axis=0) >= COSINE * COSINE - 1e-9)[0]
        if len(able):
            own = self.idf[ids]
            squared = np.concatenate([[0.0], np.cumsum(own * own)])
        for n in able.tolist():
            dots = np.concatenate([[0.0], np.cumsum(self.unit[n][ids] * own)])
            m = len(self.templates[n].words)
            for size in sorted({min(m, len(words)), min(m + max(1, m // 4), len(words))}):
                dot = dots[size:] - dots[:-size]
                bound = dot / np.sqrt(squared[size:] - squared[:-size])
                taken: list[int] = []
                starts = _peaks(np.round(bound, 9), size // 8 + 1)
                starts = starts[bound[starts] >= COSINE - 1e-9]
                for start in starts[np.argsort(-np.round(bound[starts], 9), kind="stable")].tolist():
                    at = bisect_left(taken, start)
                    if (at < len(taken) and taken[at] - start < size) or (at and start - taken[at - 1] < size):
                        continue
                    taken.insert(at, start)
                    window = ids[start : start + size]
                    values, counts = np.unique(window[window < none], return_counts=True)
                    known = float(((counts * self.idf[values]) ** 2).sum())
                    unknown = Counter(words[start + i] for i in np.nonzero(window == none)[0].tolist())
                    # with every unknown word at its least weight: what fails here can't reach the cosine
                    if dot[start] >= (COSINE - 1e-9) * math.sqrt(known + sum(c * c for c in unknown.values())):
                        out.append((n, start, size, float(dot[start]), known, dict(unknown)))
        return out

    def passages(self, found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
        """Of candidates (template, first word, words, cosine), those that explain most where they lie: by the cosine's fourth power times the words (of equal ones the first), each that overlaps none before it by more than a fifth."""
        out: list[tuple[int, int, int, float]] = []
        for c in sorted(found, key=lambda c: (-round(c[3], 6) ** 4 * c[2], -len(self.templates[c[0]].words), c[1], c[0])):
            if all(5 * (min(c[1] + c[2], x[1] + x[2]) - max(c[1], x[1])) <= min(c[2], x[2]) for x in out):
                out.append(c)
        return sorted(out, key=lambda c: c[1])

    def _joined(self, named: list[list]) -> None:
        """Gives the passages of one text to the licence that has most of it: its paragraphs may be like those of others. Whole licences stay what they are."""
        at = 0
        while at < len(named):
            upto = at + 1
            while upto < len(named) and named[upto][1] - (named[upto - 1][1] + named[upto - 1][2]) <= GAP:
                upto += 1
            words: Counter[str] = Counter()
            for name, _, size, _, kind in named[at:upto]:
                if kind == "part":
                    words[name] += size
            if words:
                name = min(words, key=lambda x: (-words[x], x))
                if words[name] >= MOST * sum(words.values()):
                    for p in named[at:upto]:
                        if p[4] != "whole":
                            p[0] = name
            at = upto

    def decided(self, found: list[tuple[int, int, int, float]], declared: list[str], words: int, file_name: bool) -> tuple[list[str], str | None, float | None, int, bool]:
        """All licences (sorted), that of most words (declared ones first), its best cosine, passages, and whether the document is a licence file."""
        chosen = self.passages(found)
        has: Counter[str] = Counter()
        for n in {c[0] for c in chosen}:
            for name in self.templates[n].names if self.templates[n].kind == "part" else ():
                has[name] += len(self.templates[n].words)
        single = {t.names[0] for t in (self.templates[c[0]] for c in chosen) if len(t.names) == 1}
        named = []
        for n, start, size, cosine in chosen:
            names = self.templates[n].names
            known = [x for x in names if x in single] or names
            named.append([min(known, key=lambda x: (-has[x] / self.body.get(x, 1), -has[x], x)), start, size, cosine, self.templates[n].kind])
        self._joined(named)
        covered: Counter[str] = Counter()
        cosines: dict[str, float] = {}
        inside, end = 0, 0
        for name, start, size, cosine, _ in named:
            covered[name] += size
            cosines[name] = max(cosines.get(name, 0.0), round(cosine, 6))
            inside += max(0, start + size - max(start, end))
            end = max(end, start + size)
        for name in declared:
            cosines[name] = 1.0
        if not cosines:
            return [], None, None, 0, False
        first = declared[0] if declared else min(covered, key=lambda x: (-covered[x], -cosines[x], x))
        is_file = bool(chosen) and (inside >= FILE_SHARE * words or file_name)
        return sorted(cosines), first, cosines[first], len(chosen) + len(declared), is_file


def weight(df: int, documents: int) -> float:
    return math.log((documents + 1) / (df + 1)) + 1


def declared(text: str) -> list[str]:
    """The licences that SPDX lines name, in order, once each; endings -only, -or-later and + aside."""
    if "SPDX-License-Identifier:" not in text:
        return []
    known = {n.lower(): n for n in {name for name, _ in NOTICES} | {p.stem for p in TEXTS.glob("*.txt")}}
    out: dict[str, None] = {}
    for m in SPDX.finditer(text):
        parts = re.split(r"[ \t]+", m[1])
        for before, part in zip(["", *parts], parts, strict=False):
            name = re.sub(r"(?i)(-only|-or-later|\+)$", "", part.strip("()"))
            if part not in ("AND", "OR", "WITH") and before != "WITH":
                out[known.get(name.lower(), name)] = None
    return list(out)


def _bucket(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) % FILTER


def _frequencies(texts: DataFrame, wanted) -> DataFrame:
    """word, n: in how many documents each word occurs of which wanted(word) holds; b"" stands for the documents themselves. wanted: a function made on the worker by calling it without arguments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = wanted()
        counts: Counter[bytes] = Counter()
        table = lambda: pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for t in utf8(batch.column(0)):
                counts.update(keep(set(words_of(t.as_py() or b""))))
                counts[b""] += 1
                if len(counts) > HELD:
                    yield table()
                    counts.clear()
        yield table()

    return texts.mapInArrow(alone("licenses", run), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


_CANDIDATES = "array<struct<template:int,start:int,size:int,dot:double,known:double,unknown:array<struct<word:binary,tf:int>>>>"
_KIND = pa.list_(
    pa.struct([("template", pa.int32()), ("start", pa.int32()), ("size", pa.int32()), ("dot", pa.float64()), ("known", pa.float64()), ("unknown", pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int32())])))])
)
_FIELDS = ("template", "start", "size", "dot", "known", "unknown")


def scan(df: DataFrame, id_column: str, text_column: str, path: Column) -> DataFrame:
    """id, path, licenses (own ones, sorted), license, its best cosine, n_passages (with SPDX lines), is_file of each row.

    A null or empty text has none, nor has one without words; an empty table gives an empty result. Repeated rows and equal
    ids stay rows of their own. Very long texts are compared whole. Of licences with equally many words the one with the
    greater cosine counts, then the first by name. No other column of df is looked at. Texts aren't shuffled; the
    candidates' unknown words are.
    """
    spark = df.sparkSession
    source = df.select(row_id().alias("row"), F.col(id_column).alias("id"), path.alias("path"), F.col(text_column).alias("text"))
    texts = source.select("text")
    known = frozenset(w for t in templates() for w in t.words)
    with small_batches(spark):
        frequency = {bytes(r["word"]): r["n"] for r in _frequencies(texts, lambda: known.intersection).collect()}  # as many rows as templates have words
    documents = frequency.pop(b"", 0)
    shipped = spark.sparkContext.broadcast(Matcher(frequency, documents))  # of the templates' size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = shipped.value
        for batch in batches:
            total, spdx, candidates = [], [], []
            for t in utf8(batch.column(3)):
                text = t.as_py() or b""
                words = words_of(text)
                total.append(len(words))
                spdx.append(declared(text.decode()))
                candidates.append([dict(zip(_FIELDS, (*c[:5], [{"word": w, "tf": n} for w, n in c[5].items()]), strict=True)) for c in matcher.candidates(words)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(total, pa.int64()), pa.array(spdx, pa.list_(pa.string())), pa.array(candidates, _KIND)], names=["row", "id", "path", "n_words", "declared", "candidates"]
            )

    found = written(source.mapInArrow(alone("licenses", run), f"row bigint, id {source.schema['id'].dataType.simpleString()}, path string, n_words bigint, declared array<string>, candidates {_CANDIDATES}"), "candidates")
    each = found.select("row", F.posexplode("candidates").alias("nth", "c"))
    unknown = each.select("row", "nth", F.explode("c.unknown").alias("u")).select("row", "nth", "u.word", "u.tf")
    df_of = written(_of_unknown(texts, unknown), "frequencies")
    rest = unknown.join(df_of, "word").groupBy("row", "nth").agg(F.sum(F.pow(F.col("tf") * (F.log((documents + 1) / (F.col("n") + 1)) + 1), F.lit(2.0))).alias("rest"))
    cosine = F.col("c.dot") / F.sqrt(F.col("c.known") + F.coalesce("rest", F.lit(0.0)))
    good = each.join(rest, ["row", "nth"], "left").select("row", "c.template", "c.start", "c.size", cosine.alias("cosine")).where(F.col("cosine") >= COSINE)
    of_row = good.groupBy("row").agg(F.collect_list(F.struct("template", "start", "size", "cosine")).alias("found"))  # of one document each
    rows = found.join(of_row, "row", "left").select("id", "path", "n_words", "declared", "found")
    named = re.compile(FILE_NAME)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = shipped.value
        for batch in batches:
            out = []
            for p, words, spdx, met in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                out.append(matcher.decided([(c["template"], c["start"], c["size"], c["cosine"]) for c in met or ()], spdx, words, bool(p and named.search(p))))
            columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.list_(pa.string()), pa.string(), pa.float64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "path", "licenses", "license", "cosine", "n_passages", "is_file"])

    result = written(rows.mapInArrow(alone("licenses", decide), f"id {source.schema['id'].dataType.simpleString()}, path string, licenses array<string>, license string, cosine double, n_passages bigint, is_file boolean"), "licenses")
    for table in (found, df_of):
        forget(table)
    return result


def _of_unknown(texts: DataFrame, unknown: DataFrame) -> DataFrame:
    """word, n of the candidates' unknown words. A filter of fixed size goes to the documents; what it lets through by chance is dropped by the join."""
    words = unknown.select("word").distinct()

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique([_bucket(w) for w in batch.column(0).to_pylist()]).astype(np.int64))], names=["bucket"])

    seen = np.zeros(FILTER, dtype=bool)
    with small_batches(texts.sparkSession):
        seen[words.mapInArrow(alone("licenses", buckets), "bucket bigint").distinct().toArrow()["bucket"].to_numpy()] = True  # FILTER rows at most
    shipped = texts.sparkSession.sparkContext.broadcast(np.packbits(seen))

    def wanted():
        there, kept = np.unpackbits(shipped.value).astype(bool).tolist(), {}

        def keep(some: set[bytes]) -> list[bytes]:
            out = []
            for w in some:
                ok = kept.get(w)
                if ok is None:
                    if len(kept) >= HELD:
                        kept.clear()
                    ok = kept[w] = there[_bucket(w)]
                if ok:
                    out.append(w)
            return out

        return keep

    return _frequencies(texts, wanted).join(words, "word", "left_semi") if seen.any() else words.select("word", F.lit(0).cast("bigint").alias("n"))


def inherited(found: DataFrame) -> DataFrame:
    """found (of scan(), as a written table) with license and origin: own (header or file), inherited (with its directory), or none.

    A directory's licence is that of most of its licence files (of equally many the first by name). A null path is the root.
    Rows stay as they are, repeated ones too; an empty table gives an empty result. Other columns are left out.
    """
    directory = F.regexp_extract(F.coalesce("path", F.lit("")), r"^(.*)/[^/]*$", 1)
    placed = found.withColumn("directory", directory)
    votes = placed.where("is_file").groupBy("directory", "license").agg(F.count("*").alias("n"))
    speaks = votes.groupBy(F.col("directory").alias("ancestor")).agg(F.max_by("license", F.struct("n", F.expr("transform(split(license, ''), c -> -ascii(c))"))).alias("license"))
    every = placed.select("directory").distinct()
    above = every.select("directory", F.explode(F.expr("transform(sequence(0, size(split(directory, '/'))), n -> array_join(slice(split(directory, '/'), 1, n), '/'))")).alias("ancestor"))
    nearest = above.join(speaks, "ancestor").groupBy("directory").agg(F.max_by(F.struct("ancestor", "license"), F.length("ancestor")).alias("of"))
    salted = nearest.select("directory", "of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = placed.withColumn("salt", F.pmod(F.xxhash64("id", "path"), F.lit(SALTS)).cast("int")).join(salted, ["directory", "salt"], "left")
    own = F.col("license").isNotNull()
    return joined.select(
        "id",
        "path",
        "licenses",
        F.coalesce("license", "of.license").alias("license"),
        F.when(F.col("is_file"), "file").when(own, "header").when(F.col("of").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~own, F.col("of.ancestor")).alias("inherited_from"),
        "cosine",
        "n_passages",
    )
