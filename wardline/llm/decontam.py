"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of 13 consecutive item words (a shorter item is one window). For each window
length there is one search table: the shift table says, for the block of words that ends at the
current position, how far the next possible window end is; only where it says zero are the windows
with that suffix block looked up, and a direct comparison confirms the occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.common import cut, named

#: Bytes to bytes: A-Z to a-z; what no word has (ASCII but digits and letters) to a space.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


#: A search table for windows of one length: (length, words of a block, shift by block, items by window by suffix block).
Table = tuple[int, int, dict[bytes, int], dict[bytes, dict[bytes, tuple[str, ...]]]]


def search_table(length: int, windows: dict[tuple[bytes, ...], set[str]]) -> Table:
    block = min(2, length)
    default = length - block + 1
    shift: dict[bytes, int] = {}
    buckets: dict[bytes, dict[bytes, tuple[str, ...]]] = {}
    for window, items in windows.items():
        for end in range(block, length + 1):
            key = b" ".join(window[end - block : end])
            if length - end < shift.get(key, default):
                shift[key] = length - end
        buckets.setdefault(b" ".join(window[length - block :]), {})[b" ".join(window)] = tuple(items)
    return length, block, shift, buckets


def search(table: Table, words: list[bytes]) -> Iterator[tuple[int, tuple[str, ...]]]:
    """(end, items) for every occurrence; the window is words[end - length : end]."""
    n, size, shift, buckets = table
    default, end, last = n - size + 1, n, len(words)
    while end <= last:
        block = words[end - 2] + b" " + words[end - 1] if size == 2 else words[end - 1]
        step = shift.get(block, default)
        if step:
            end += step
            continue
        found = buckets[block].get(b" ".join(words[end - n : end]))
        if found is not None:
            yield end, found
        end += 1


def search_tables(items: list[tuple[str, bytes]], window: int) -> list[Table]:
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            by_length.setdefault(n, {}).setdefault(tuple(words[i : i + n]), set()).update([item] if item is not None else [])
    return [search_table(n, w) for n, w in sorted(by_length.items())]


def _cut_items(benchmark: DataFrame, id_col: str, text_col: str, window: int, piece_words: int) -> DataFrame:
    """(item, text) with long items cut into overlapping pieces that hold every window exactly as the item does."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = [], []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                words = words_of(text or b"")
                for at in range(0, max(1, len(words) - window + 1) if words else 0, piece_words):
                    ids.append(item)
                    texts.append(b" ".join(words[at : at + piece_words + window - 1]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["item", "text"])

    return rows.mapInArrow(scan, "item string, text string").distinct()


_RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")
_KINDS = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>"


def _searched(tables: list[Table], text: bytes) -> tuple[int, set[str], list[int]]:
    """(words, items found, places as start, end, start, end and so on) of one text."""
    words = words_of(text)
    found: set[str] = set()
    ranges: list[int] = []
    for t in tables:
        for end, names in search(t, words):
            found.update(names)
            if ranges and ranges[-2] <= end - t[0] <= ranges[-1]:
                ranges[-1] = max(ranges[-1], end)
            else:
                ranges += [end - t[0], end]
    return len(words), found, ranges


def _judged(n_words: list[int], items: list[list[str]], places: list[list[int]]) -> list[pa.Array]:
    """The columns _RESULTS."""
    merged = [merge(x) for x in places]
    n, n_hit = np.array(n_words, np.int64), np.array([sum(z - a for a, z in m) for m in merged], np.int64)
    return [
        pa.array(n), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
        pa.array((n_hit > 0) & (20 * n_hit >= n)), pa.array([[{"start": a, "end": z} for a, z in m] for m in merged], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",), window: int = 13, block_bytes: int = 16 << 20,
) -> DataFrame:
    """The columns `keep` of every document, `n_words`, `n_hit`, `n_items`, `items_sha256`, `contaminated`, `spans`.

    `spans` holds the word ranges [start, end) inside which a window occurs, merged. The benchmark's
    size is summed first. Up to `block_bytes` of text its search tables are one broadcast, and documents are read
    once. A larger one is dealt by hash into blocks of about that size: rows are numbered in a checkpoint, each
    block is a pass that leaves what it found of the rows that it hit, and its broadcast is destroyed before
    the next; so what is resident is bounded however large the benchmark is. Nulls and empty texts have no
    words: no hits, the digest of an empty list, not contaminated. An item without words is ignored; a
    window of an item with a null id hits, but names no item. Repeated rows are judged one by one; an empty
    benchmark contaminates nothing. A column of `keep` named like a result gives way to it.
    """
    context = docs.sparkSession.sparkContext
    pieces = _cut_items(benchmark, item_col, item_text_col, window, 4096)
    total = pieces.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    keep = tuple(named(docs, keep, _RESULTS))
    rows = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(keep)], docs[text_col].cast("string").alias("text"))
    kept = rows.schema.fields[:-1]
    results = T._parse_datatype_string(_KINDS).fields

    def given(part: DataFrame):
        return context.broadcast(search_tables([(r.item, r.text.encode()) for r in part.collect()], window))

    if blocks == 1:
        tables = given(pieces)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [_searched(tables.value, t.as_py() or b"") for t in b.column(len(kept)).cast(pa.large_binary())]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *_judged([n for n, _, _ in got], [sorted(x) for _, x, _ in got], [r for _, _, r in got])], [*b.schema.names[:-1], *_RESULTS])

        return rows.mapInArrow(scan, T.StructType([*kept, *results])).toDF(*keep, *_RESULTS)

    numbered = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    passes = None
    for k in range(blocks):
        tables = given(pieces.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k))

        def hits(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [(i, *_searched(tables.value, t.as_py() or b"")[1:]) for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), strict=True)]
                got = [g for g in got if g[2]]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([sorted(g[1]) for g in got], pa.list_(pa.string())), pa.array([g[2] for g in got], pa.list_(pa.int32()))], ["row", "items", "places"])

        found = cut(numbered.select("row", "text").mapInArrow(hits, "row bigint, items array<string>, places array<int>"))
        tables.destroy()
        passes = found if passes is None else passes.unionByName(found)
    # A row has a few lists, one a block that hit it.
    lists = passes.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("places")).alias("places"))
    joined = numbered.join(lists, "row", "left").select(*[f.name for f in kept], "text", "items", "places")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [len(words_of(t.as_py() or b"")) for t in b.column(len(kept)).cast(pa.large_binary())]
            items, places = ([x or [] for x in b.column(len(kept) + j).to_pylist()] for j in (1, 2))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *_judged(counts, [sorted(x) for x in items], places)], [*b.schema.names[: len(kept)], *_RESULTS])

    return joined.mapInArrow(judge, T.StructType([*kept, *results])).toDF(*keep, *_RESULTS)


def merge(flat: list[int]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges, given as start, end, start, end and so on, as sorted disjoint ones."""
    out: list[list[int]] = []
    for a, z in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]
