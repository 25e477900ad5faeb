"""Helpers shared by the corpus operators: reading tables, cutting lineage, components, Arrow batches."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the token contracts: space and U+0009 to U+000D, as a Java regex class.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """`df` behind a reliable checkpoint, in the folder that the session names in spark.checkpoint.dir.

    Where the session names none, a local master (tests, notebooks) gets a temporary folder, and a cluster
    one below the home of the default file system, which all executors share.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        if context.master.startswith("local") and not context.master.startswith("local-cluster"):
            context.setCheckpointDir(os.path.join(tempfile.gettempdir(), "wardline-checkpoints"))
        else:
            context.setCheckpointDir("wardline-checkpoints")  # a relative path is resolved by the default file system
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one that checkpoints go to."""
    cut(spark.range(1))  # sets a checkpoint folder where the session names none
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")


def renewed(df: DataFrame, folder: str, turn: int) -> DataFrame:
    """`df` written below `folder` and read again: what a loop of joins keeps from one round, numbered `turn`, to the next.

    A checkpoint keeps what its plan estimates of its size, for a join the product of both sides. In a loop the
    digits of that number multiply with every round, until they fill the driver's memory; files have their real
    size. Rounds take two paths by turns, so what the round before gave is there while this one is written.
    """
    path = f"{folder}/{turn % 2}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(taken: list[str], *names: str) -> list[str]:
    """`names`, each with as many underscores more as it takes to clash with no column in `taken` (in any letter case)."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def named(docs: DataFrame, keep: tuple[str, ...] | None, results: tuple[str, ...]) -> list[str]:
    """The columns to keep: `keep`, or all of `docs`; one named like a result gives way to it."""
    lower = {r.lower() for r in results}
    return [c for c in (docs.columns if keep is None else keep) if c.lower() not in lower]


def lookup(rows: DataFrame, values: DataFrame, key: str, how: str = "inner", often: int = 10_000) -> DataFrame:
    """`rows` joined with `values`, which has one row a key; `how` is inner or left.

    Keys of over a thousandth of the rows (fewer than a thousand keys, and each of over `often` rows) are
    broadcast with their values; all others are shuffled, and none of them is large. Both tables are read
    more than once: they should be checkpointed.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    hot = [r[0] for r in counts.where(F.col("n") > max(often, rows.count() // 1000)).select(key).collect()]
    columns = [*rows.columns, *[c for c in values.columns if c != key]]
    there = rows.where(F.col(key).isNotNull())  # nulls match nothing, and would all be shuffled to one task
    out = there.where(~F.col(key).isin(hot)).join(values.where(~F.col(key).isin(hot)), key, how).select(*columns)
    if hot:
        out = out.unionByName(there.where(F.col(key).isin(hot)).join(F.broadcast(values.where(F.col(key).isin(hot))), key, how).select(*columns))
    return out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True) if how == "left" else out


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: (node, root) for every node of `edges` (a, b), both bigint.

    Alternates the large-star and small-star steps until the edge set no longer changes, so the
    number of rounds grows with the logarithm of a component's diameter. Every step aggregates by
    node with a partial minimum and joins that minimum back; only the edge set itself is kept.
    `root` is the smallest node of the component. Self links and nulls are ignored.
    """
    e = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(low, "u").where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        e = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without a copy: (bytes, starts, lengths); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    elif pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lengths = at[1:] - at[:-1]
    if column.null_count:
        lengths[column.is_null().to_numpy(zero_copy_only=False)] = 0
    return raw, at[:-1], lengths


def pieces(batch: pa.RecordBatch, text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about `limit` bytes together (one long text may exceed it)."""
    _, _, lengths = text_bytes(batch.column(text))
    if not len(lengths):
        return
    group = np.cumsum(lengths) // limit
    edges = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(lengths)], strict=True):
        yield batch.slice(a, b - a)


def crc_bucket(doc_id, n: int):
    """crc32 of the id as text, modulo n, as a column."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))
