"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half of the radius (1 of 2 bits: itself and its
64 one-bit neighbours). Two fingerprints at 2 or fewer bits share a variant, so one shuffle on the
variants brings all linked fingerprints together. A variant can have at most 65 fingerprints around
it, whatever the data, so no group grows. Copies are folded into one fingerprint before that shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wardline.llm.common import connected_components, cut, free, lookup

BITS = 64


def fingerprint(text: bytes, words: int = 3) -> int:
    """Fingerprint of one UTF-8 text: majority bits of the shingles' XXH64, as unsigned 64-bit integer.

    A-Z is lower-cased; words end at space or U+0009 to U+000D; fewer words than a shingle make one
    shingle, none make fingerprint zero.
    """
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    n = max(1, len(tokens) - words + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):  # bounds the memory of very long texts
        hashes = np.array(
            [digest(joined[a:b], 42) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)],
            ">u8",
        )
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), words: int = 3) -> DataFrame:
    """The columns `keep` of every row and `fp`, its fingerprint as signed bigint. A null text is like an empty one."""
    rows = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(keep)], docs[text_col].cast("string").alias("text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("fp", T.LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).cast(pa.large_binary())
            prints = np.fromiter((fingerprint(t.as_py() or b"", words) for t in texts), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(prints.view(np.int64))], [*b.schema.names[:-1], "fp"])

    return rows.mapInArrow(scan, schema).toDF(*keep, "fp")


def balls(prints: DataFrame, radius: int) -> DataFrame:
    """(variant, fp): every fingerprint with all variants within radius // 2 bits, rounded up."""
    half = (radius + 1) // 2
    masks = [0] + [sum(1 << i for i in bits) for k in range(1, half + 1) for bits in combinations(range(BITS), k)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    flips = F.array(*[F.lit(m).cast("bigint") for m in signed])
    return prints.select("fp", F.explode(flips).alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp")


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Verified links (a, b) that connect all distinct fingerprints at `radius` or fewer bits.

    Members of a variant's ball link to the ball's least fingerprint, not to one another; for an even
    radius any two members of a ball are within the radius, so the star keeps their connection. An odd
    radius is refused, as there a star could lose links.
    """
    if radius % 2:
        raise ValueError("radius has to be even")
    ball = Window.partitionBy("variant")
    starred = balls(prints, radius).withColumn("a", F.min("fp").over(ball)).where("a <> fp")
    pairs = starred.select("a", F.col("fp").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, words: int = 3,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """One row for every row of `docs`: the id, `extra` columns, `fp`, `root` and `component_id`.

    `root` is the component's least fingerprint and names it whatever the ids are.

    `component_id` is the smallest id reachable over links of at most `radius` differing bits.
    Nulls: a null text is an empty text (fingerprint zero, which links like any other); a null id
    keeps its row, and a component whose ids are all null has a null component_id. Repeated rows
    stay repeated. An empty table gives an empty result. Other columns of `docs` are never read.
    """
    marked = cut(fingerprints(docs, text_col, (id_col, *extra), words))
    prints = cut(marked.groupBy("fp").agg(F.min(id_col).alias("first_id")))
    roots = connected_components(links(prints.select("fp"), radius))
    rooted = prints.join(roots, prints.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.select("fp", "root").join(least, "root").select("fp", "root", "component_id")
    return lookup(marked, cut(classes), "fp").select(id_col, *extra, "fp", "root", "component_id")


def hex_fingerprint(fp="fp"):
    """16 lower-case hexadecimal digits of a fingerprint column."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """The rows of `docs`, one of each near-duplicate group: that of the smallest id (null ids last).

    Rows are numbered once, in a checkpoint that the groups and the last join both read: a scan that is
    planned again may be cut into other partitions, and would number them otherwise.
    Repeated rows and equal ids count as separate rows of one group, of which the first stays.
    """
    (row,) = free(docs.columns, "row")
    placed = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = near_duplicate_groups(placed.select(placed[id_col].alias("id"), placed[text_col].alias("text"), placed[row].alias("place")), "id", "text", radius, extra=("place",))
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("place").alias("place"))
    first = groups.groupBy("root").agg(F.min(order).alias("best"))
    return placed.join(first.select(F.col("best.place").alias(row)), row, "left_semi").select(*docs.columns)
