"""Dictionary matching with offsets: one automaton over all terms, longest leftmost matches, joined to what the terms stand for."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of terms that one broadcast automaton has.
BLOCK = 1 << 22


def _lowered(text: str) -> str:
    """Lower case, one character for each: what grows in lower case stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _automaton(terms: list[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for t in terms:
        made.add_word(t, t)
    made.make_automaton()
    return made


def longest_leftmost(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of all occurrences those kept from the left, of several at one place the longest, none over another."""
    out, end = [], 0
    for a, z, t in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= end:
            out.append((a, z, t))
            end = z
    return out


def occurrences(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", term: str = "term", words: bool = True, block: int = BLOCK) -> DataFrame:
    """(key, start, stop, term): longest leftmost occurrences of the terms in each text, in any letter case; code points, `stop` exclusive.

    With `words` a match begins and ends at a word's edge. Terms come in lower case, once each; null and
    empty ones say nothing, and neither do null texts. Rows that repeat a key are searched together with
    it, so their spans come once for each. Terms are cut into broadcast blocks of about `block` characters; with
    more than one block, all occurrences of the blocks meet by text before the longest are chosen.
    """
    known = terms.where(F.col(term).isNotNull() & (F.col(term) != "")).select(F.col(term).cast("string").alias("term")).distinct()
    rows = docs.where(docs[text].isNotNull()).select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    kind = rows.schema["key"].dataType
    context = docs.sparkSession.sparkContext

    def search(given, sweep: bool):
        made = []

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if not made:
                made.append(_automaton(given.value))
            for b in batches:
                found = []
                for k, t in zip(b["key"], b["text"], strict=True):
                    low, spans = _lowered(t), []
                    for last, hit in made[0].iter(low):
                        a, z = last + 1 - len(hit), last + 1
                        if not words or ((a == 0 or not (_word(low[a - 1]) and _word(low[a]))) and (z == len(low) or not (_word(low[z]) and _word(low[z - 1])))):
                            spans.append((a, z, hit))
                    found += [(k, *s) for s in (longest_leftmost(spans) if sweep else spans)]
                yield pd.DataFrame(found, columns=["key", "start", "stop", "term"])

        return scan

    schema = T.StructType([T.StructField("key", kind), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("term", T.StringType())])
    blocks, now, size = [], [], 0
    for r in known.orderBy("term").toLocalIterator():
        low = _lowered(r.term)
        now.append(low)
        size += len(low)
        if size >= block:
            blocks, now, size = [*blocks, now], [], 0
    blocks += [now] if now else []
    if not blocks:
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    if len(blocks) == 1:
        return rows.mapInPandas(search(context.broadcast(blocks[0]), True), schema).withColumnRenamed("key", key)
    out = None
    for b in blocks:
        part = rows.mapInPandas(search(context.broadcast(b), False), schema)
        out = part if out is None else out.unionByName(part)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        spans = longest_leftmost(list(group[["start", "stop", "term"]].drop_duplicates().itertuples(index=False, name=None)))
        return pd.DataFrame([(group["key"].iloc[0], *s) for s in spans], columns=["key", "start", "stop", "term"])

    return out.groupBy("key").applyInPandas(choose, schema).withColumnRenamed("key", key)


def meanings(found: DataFrame, terms: DataFrame, term: str = "term") -> DataFrame:
    """Spans joined with the other columns of the dictionary; a term of several meanings gives a row each."""
    return found.join(terms, term)
