"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Every line of a text, every template's best window of as many terms, and the text as a whole are sparse
TF-IDF vectors; the cosine to a licence's templates (notices, tags, headers, whole texts) names the licence.
Document frequencies of all terms are counted over all texts: those of templates and of common terms go
along with the scan, those of rare terms are joined to the few passages that have them. Directories hold what
their licence files declare, and a file without a licence of its own takes that of the nearest directory
above it, found by a join on ancestor paths.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.common import cut, free, lookup, named
from wardline.llm.license_texts import NOTICES, TAGS, TEXTS

PATTERN = r"[a-z0-9]+(?:\.[0-9]+)*"
TERM = re.compile(PATTERN)

#: (licence, text, least cosine): a tag has to be whole, as all tags share most of their words.
Template = tuple[str, str, float]


def templates_of(notices: dict[str, list[str]] = NOTICES, tags: dict[str, list[str]] = TAGS, texts: dict[str, list[str]] = TEXTS, threshold: float = 0.6) -> list[Template]:
    found = [(name, t, threshold) for name, all_ in notices.items() for t in all_]
    found += [(name, f"SPDX-License-Identifier: {t}", 0.95) for name, all_ in tags.items() for t in all_]
    return found + [(name, t, threshold) for name, all_ in texts.items() for t in all_]


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


def document_frequencies(docs: DataFrame, text_col: str) -> DataFrame:
    """(term, df) of every term of all texts."""
    every = F.array_distinct(F.regexp_extract_all(F.lower(docs[text_col].cast("string")), F.lit(PATTERN), F.lit(0)))
    return docs.select(F.explode(every).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


class Scanner:
    """Cosines to templates, with weights (1 + log tf) * (log((n + 1) / (df + 1)) + 1).

    `df` has all terms of the templates and all that are in over `rarest` texts; a term that isn't there is
    rare, and its weight is left open.
    """

    def __init__(self, templates: list[Template], n: int, df: dict[str, int], rarest: float):
        own = {t for _, text, _ in templates for t in terms(text)}
        self.idf = {t: log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in own | set(df)}
        self.least_rare = log((n + 1) / (rarest + 1)) + 1
        self.names, self.least = [t[0] for t in templates], [t[2] for t in templates]
        self.lengths = [len(terms(t[1])) for t in templates]
        self.vectors = []
        for _, text, _ in templates:
            v = {t: (1 + log(c)) * self.idf[t] for t, c in Counter(terms(text)).items()}
            size = sqrt(sum(x * x for x in v.values())) or 1.0
            self.vectors.append({t: x / size for t, x in v.items()})
        # A short template's own words: those that no other licence's short template has; one of them has to be there.
        short = [i for i, n in enumerate(self.lengths) if n < 40]
        self.needed = [frozenset(self.vectors[i]) - {t for j in short if self.names[j] != self.names[i] for t in self.vectors[j]} if i in short else frozenset() for i in range(len(templates))]
        self.by_term: dict[str, list[tuple[int, float]]] = {}
        for i, v in enumerate(self.vectors):
            for t, x in v.items():
                self.by_term.setdefault(t, []).append((i, x))

    def hopeful(self, there: set[str]) -> list[int]:
        """Templates whose cosine can reach their threshold: it is at most the norm of the template over the terms that are there."""
        square = [0.0] * len(self.vectors)
        for t in there & self.by_term.keys():
            for i, x in self.by_term[t]:
                square[i] += x * x
        return [i for i, s in enumerate(square) if s >= self.least[i] ** 2 - 1e-9 and (not self.needed[i] or self.needed[i] & there)]

    def passage(self, words: list[str], whole: bool, candidates: list[int]) -> Iterator[dict]:
        """What a passage's cosine to each template that it may reach is made of."""
        counts = Counter(words)
        able = set(self.hopeful(set(counts))).intersection(candidates)
        if not able:
            return
        known = {t: (1 + log(c)) * self.idf[t] for t, c in counts.items() if t in self.idf}
        rare = {t: 1 + log(c) for t, c in counts.items() if t not in self.idf}
        square = sum(x * x for x in known.values())
        most = sqrt(square + sum(x * x for x in rare.values()) * self.least_rare**2)
        for i in sorted(able):
            dot = sum(x * self.vectors[i].get(t, 0.0) for t, x in known.items())
            if dot / most >= self.least[i] - 1e-9:
                yield {"template": i, "dot": dot, "square": square, "whole": whole, "rare": [{"term": t, "weight": x} for t, x in sorted(rare.items())]}

    def scan(self, text: str) -> list[dict]:
        """The passages of a text that may declare a licence; none that does is left out."""
        words = terms(text)
        candidates = self.hopeful(set(words))
        if not candidates:
            return []
        lines = [line for line in text.split("\n") if line]
        found = list(self.passage(words, True, candidates))
        if len(lines) > 1:
            for line in lines:
                found += self.passage(terms(line), False, candidates)
        for i in candidates:
            if (n := self.lengths[i]) < len(words):
                found += self.passage(words[(at := self.window(words, i)) : at + n], False, [i])
        return found

    def window(self, words: list[str], i: int) -> int:
        """Start of the first window of as many terms as template i with most of the template's weight in it."""
        v, n = self.vectors[i], self.lengths[i]
        total = np.cumsum([0.0, *(v.get(w, 0.0) ** 2 for w in words)])
        return int(np.argmax(np.round(total[n:] - total[:-n], 9)))


def scan_licenses(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] | None = None, templates: list[Template] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (by default all) and `own_license`, `cosine` (6 places), `whole_text`.

    Null and empty texts have no licence and cosine 0. Whole texts are read. Repeated rows get equal
    results; an empty table gives an empty result; columns named like the results give way to them. Terms
    in over a hundredth of the texts come to the driver: they are at most a hundred times as many as a
    text's mean number of different terms. What the scan leaves is checkpointed, without the texts.
    """
    kept = named(docs, keep, ("own_license", "cosine", "whole_text"))
    templates = templates_of() if templates is None else templates
    n, frequencies = docs.count(), cut(document_frequencies(docs, text_col))
    own = sorted({t for _, text, _ in templates for t in terms(text)})
    known = frequencies.where((F.col("df") > n / 100) | F.col("term").isin(own))
    scanner = Scanner(templates, n, {r.term: r.df for r in known.collect()}, n / 100)
    rows = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(kept)], docs[text_col].cast("string").alias("text"))
    rare = pa.struct([("term", pa.string()), ("weight", pa.float64())])
    kind = pa.list_(pa.struct([("template", pa.int32()), ("dot", pa.float64()), ("square", pa.float64()), ("whole", pa.bool_()), ("rare", pa.list_(rare))]))
    fields = T._parse_datatype_string("found array<struct<template:int,dot:double,square:double,whole:boolean,rare:array<struct<term:string,weight:double>>>>").fields

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scanner.scan(t.as_py() or "") for t in b.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, kind)], [*b.schema.names[:-1], "found"])

    scanned = cut(rows.mapInArrow(scan, T.StructType([*rows.schema.fields[:-1], *fields])).withColumn("row", F.monotonically_increasing_id()))
    least, names = F.lit(scanner.least), F.array(*[F.lit(x) for x in scanner.names])
    passages = scanned.where(F.size("found") > 0).select("row", F.posexplode("found").alias("at", "p")).select("row", "at", "p.*")
    weights = passages.select("row", "at", F.explode("rare").alias("r")).join(frequencies, F.col("r.term") == F.col("term"))
    square = F.col("r.weight") * (F.log((n + 1) / (F.col("df") + 1)) + 1)
    open_ = weights.groupBy("row", "at").agg(F.sum(square * square).alias("more"))
    cosine = F.col("dot") / F.sqrt(F.col("square") + F.coalesce("more", F.lit(0.0)))
    scored = passages.drop("rare").join(open_, ["row", "at"], "left").withColumn("cosine", F.round(cosine, 6))
    named_ = scored.where(F.col("cosine") >= F.get(least, F.col("template"))).select("row", F.struct((-F.col("cosine")).alias("c"), F.get(names, F.col("template")).alias("name"), (~F.col("whole")).alias("part")).alias("b"))
    best = named_.groupBy("row").agg(F.min("b").alias("b"))
    joined = scanned.join(best, "row", "left")
    return joined.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col("b.name").alias("own_license"), F.coalesce(-F.col("b.c"), F.lit(0.0)).alias("cosine"), F.coalesce(~F.col("b.part"), F.lit(False)).alias("whole_text"),
    )


def directory(path: Column) -> Column:
    """The path without its last part; null for a null path, '' at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).when(path.isNotNull(), "")


def inherit(scanned: DataFrame, path_col: str = "path", declares: Column | None = None) -> DataFrame:
    """`scanned` with `license` and `license_from`: own, or that of the nearest ancestor directory with a licence file.

    `declares` says which rows are licence files (by default those named LICENSE, LICENCE or COPYING,
    with or without an ending). Of several in a directory the highest cosine counts, then the first
    name. A null path has no directory. What was scanned is checkpointed, as three steps read it. Distinct
    directories alone are joined with their ancestors, then files with their directory; a directory that is
    above or around over a thousandth of them is broadcast, so it is no hot key. Columns named like the
    results give way to them.
    """
    if declares is None:
        declares = F.col(path_col).rlike(r"(?i)(^|/)(licen[cs]e|copying)(\.[a-z]+)?$")
    kept = named(scanned, None, ("license", "license_from"))
    place, up, near = free(scanned.columns, "place", "up", "near")
    rows = cut(scanned.select(*kept).withColumn(place, directory(F.col(path_col))))
    declared = cut(rows.where(declares & F.col("own_license").isNotNull()).groupBy(F.col(place).alias(up)).agg(
        F.min(F.struct((-F.col("cosine")).alias("c"), F.col("own_license").alias("l"))).alias("best")))
    parts = F.split(place, "/")
    ups = F.array_append(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")), F.lit(""))
    above = cut(rows.select(place).dropna().distinct().select(place, F.explode(F.array_distinct(ups)).alias(up)))
    nearest = cut(lookup(above, declared, up).groupBy(place).agg(F.max(F.struct(F.length(up).alias("n"), F.col(up).alias("up"), "best.l")).alias(near)))
    joined = lookup(rows, nearest, place, "left")
    own = F.col("own_license").isNotNull()
    return joined.select(
        *kept, F.coalesce("own_license", f"{near}.l").alias("license"),
        F.when(own, F.lit("own")).when(F.col(near).isNotNull(), F.col(f"{near}.up")).alias("license_from"),
    )
