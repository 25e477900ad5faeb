"""A stored vector index: coarse cells by k-means, probes, exact rescoring, and an exact way.

Centres are learnt from a bounded sample; every vector is stored in the cell of its nearest centre. A
search sends each query to the cells whose centres are nearest. Cells are packed into blocks, and a query goes to a
block once, with those of its cells that are there: a cell that holds a third of all vectors is many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.operators.retrieval import top_k

#: Rows of a block on either side at most, blocks of the vectors that a search aims at if they are small, and scores that are held at once.
BLOCK, BLOCKS, SCORES = 16384, 48, 2_000_000


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _packed(counts: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """(cell, first block, number of blocks): small cells share a block of about `most` rows, a larger cell has blocks of its own."""
    out, block, filled = [], 0, 0
    for cell, n in sorted(counts.items()):
        parts = max(1, -(-n // most))
        if filled and filled + n > most:
            block, filled = block + 1, 0
        out.append((cell, block, parts))
        block, filled = (block + parts, 0) if parts > 1 else (block, filled + n)
    return out


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the `k` best finite scores of each row; of equal ones the first."""
    n = scores.shape[1]
    least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)
    row, column = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], column[keep]


class VectorIndex:
    """Vectors (id, v) of one dimension in a folder that executors share. Null vectors are left out."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def build(self, vectors: DataFrame, key: str = "doc_id", vector: str = "v", cells: int | None = None, sample: int = 20_000, seed: int = 7, target: float = 0.95, tried: int = 200) -> None:
        """Learns centres on at most about `sample` vectors (a hash of the id chooses), and writes all vectors by cell.

        By default there are as many cells as the square root of their number, at most 1024, so the centres
        that every task gets have a bounded size. Then the least number of probes is found that gives the 10
        nearest others of about `tried` stored vectors with a recall of `target`, against the exact search.
        """
        rows = vectors.where(vectors[vector].isNotNull()).select(vectors[key].alias("id"), vectors[vector].cast("array<double>").alias("v"))
        n = rows.count()
        size = cells or max(1, min(1024, round(n**0.5)))
        million = 1_000_000
        some = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(million)) < max(1, min(million, -(-sample * million // max(n, 1)))))
        unit = F.transform("v", lambda x: F.coalesce(F.try_divide(x, F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y))), F.lit(0.0)))
        picked = some.select(array_to_vector(unit).alias("features"))
        if picked.isEmpty():
            picked = rows.select(array_to_vector(unit).alias("features"))
        centres = [c.tolist() for c in KMeans(k=size, seed=seed, maxIter=15).fit(picked).clusterCenters()] if n else []
        self.spark.createDataFrame([(i, c) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/centres")
        if not n:
            return
        placed = rows.mapInPandas(self._placer(1), T.StructType([*rows.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))]))
        placed.select("id", "v", F.element_at("cells", 1).alias("cell")).repartition("cell").sortWithinPartitions("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.folder}/vectors")

        share = max(1, min(million, -(-tried * million // max(n, 1))))
        asked = rows.where(F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(million)) < share).select(F.col("id").alias("query_id"), "v")
        truth = self.search(asked, 10, exact=True, own=False)
        where = truth.join(self.spark.read.parquet(f"{self.folder}/vectors").select("id", "cell"), "id").select("query_id", "cell")
        order = asked.mapInPandas(self._placer(size), T.StructType([*asked.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])).select("query_id", F.posexplode("cells").alias("place", "cell"))
        needed = where.join(order, ["query_id", "cell"]).groupBy("place").agg(F.count("*").alias("n")).orderBy("place").collect()  # a row a cell at most
        have, total, probes = 0, sum(r.n for r in needed), 1
        for r in needed:
            if have >= target * total:
                break
            have, probes = have + r.n, r.place + 1
        self.spark.createDataFrame([(probes, have / total if total else 1.0)], "probes int, recall double").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/tuning")

    def _placer(self, probes: int):
        """Adds to rows (..., v) the `probes` nearest cells, nearest first."""
        centres = np.array([r.centre for r in self.spark.read.parquet(f"{self.folder}/centres").orderBy("cell").collect()])
        given = self.spark.sparkContext.broadcast(centres)  # at most 1024 centres

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            middle = given.value
            for b in batches:
                if not len(b):
                    continue
                x = _unit(_matrix(b["v"]))
                far = (middle**2).sum(1)[None, :] - 2 * x @ middle.T
                near = np.argsort(far, axis=1, kind="stable")[:, :probes]
                yield b.assign(cells=[[int(c) for c in row] for row in near])

        return place

    def _sender(self, places: list[tuple[int, int, int]], probes: int | None):
        """Queries (query_id, v) to a row for each block that has some of their `probes` nearest cells (or of cell 0), with those cells."""
        placed = self._placer(probes) if probes else lambda batches: (b.assign(cells=[[0]] * len(b)) for b in batches)
        n_cells = self.spark.read.parquet(f"{self.folder}/centres").count()
        first, parts = np.zeros(n_cells, np.int64), np.zeros(n_cells, np.int64)  # a cell without vectors has no blocks
        for c, block, n in places:
            first[c], parts[c] = block, n
        width = int((first + parts).max()) + 1

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in placed(batches):
                for start in range(0, len(whole), 256):
                    b = whole.iloc[start : start + 256]
                    near = np.array(b["cells"].to_list(), np.int64)
                    cells = near.ravel()
                    times = parts[cells]
                    part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    key = np.repeat(np.repeat(np.arange(len(b)), near.shape[1]), times) * width + np.repeat(first[cells], times) + part
                    order = np.argsort(key, kind="stable")
                    key, cells = key[order], np.repeat(cells, times)[order].astype(np.int32)
                    if len(key):
                        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                        out = b.iloc[key[starts] // width].drop(columns="cells")
                        yield out.assign(block=(key[starts] % width).astype(np.int32), cells=np.split(cells, starts[1:]))

        return send

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, metric: str = "cosine", key: str = "query_id", vector: str = "v", exact: bool = False, own: bool = True) -> DataFrame:
        """(query_id, id, score, rank): the `k` best of each query in its `probes` nearest cells, or with `exact` in all, by exact scores.

        Without `probes` as many are made as building found to be enough. A query with a null vector has no rows; with `own` false a query's own id is no answer. Ties go by
        id. Vectors are dealt to blocks of at most about BLOCK rows, whole cells where they fit, and queries likewise; every pair
        of blocks is a few matrix products, and only a block's k best go on.
        """
        if self.spark.read.parquet(f"{self.folder}/centres").isEmpty():
            return queries.select(queries[key].alias("query_id"), queries[key].alias("id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).where("false")
        stored = self.spark.read.parquet(f"{self.folder}/vectors")
        asked = queries.where(queries[vector].isNotNull()).select(queries[key].alias("query_id"), queries[vector].cast("array<double>").alias("v"))
        counts = {r.cell: r["count"] for r in stored.groupBy("cell").count().collect()}  # at most 1024 rows
        if exact:
            stored, counts = stored.withColumn("cell", F.lit(0)), {0: sum(counts.values())}
        else:
            probes = probes or self.spark.read.parquet(f"{self.folder}/tuning").first().probes
        places = _packed(counts, min(BLOCK, max(1, -(-sum(counts.values()) // BLOCKS))))
        sides = max(1, -(-asked.count() // BLOCK))
        table = F.broadcast(self.spark.createDataFrame(places, "cell int, first int, parts int"))
        left = stored.join(table, "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        left = left.select("id", "v", "cell", "block", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))).alias("side"))
        fields = [*asked.schema.fields, T.StructField("block", T.IntegerType()), T.StructField("cells", T.ArrayType(T.IntegerType()))]
        right = asked.mapInPandas(self._sender(places, None if exact else probes), T.StructType(fields)).withColumn("side", F.pmod(F.xxhash64("query_id"), F.lit(sides)).cast("int"))
        groups = ["block", "side"]
        kind = stored.schema["id"].dataType
        out = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("id", kind), T.StructField("score", T.DoubleType())])

        scores_at_once = SCORES

        def best(rows: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(given):
                return pd.DataFrame({"query_id": [], "id": [], "score": []})
            rows = rows.sort_values("id")
            x, q, ids, names = _matrix(rows["v"]), _matrix(given["v"]), rows["id"].to_numpy(), given["query_id"].to_numpy()
            if metric == "cosine":
                x, q = _unit(x), _unit(q)
            here, cell = np.unique(rows["cell"].to_numpy(), return_inverse=True)
            wanted = np.concatenate(given["cells"].to_list())
            who, at = np.repeat(np.arange(len(q)), given["cells"].map(len).to_numpy()), np.minimum(np.searchsorted(here, wanted), len(here) - 1)
            probed = np.zeros((len(q), len(here)), bool)
            probed[who[here[at] == wanted], at[here[at] == wanted]] = True
            found, step = [], max(1, scores_at_once // len(x))
            for at in range(0, len(q), step):
                scores = np.round(q[at : at + step] @ x.T, 9)
                if not probed[at : at + step].all():
                    scores[~probed[at : at + step][:, cell]] = -np.inf
                if not own:
                    scores[names[at : at + step, None] == ids[None, :]] = -np.inf
                row, column = _best(scores, k)
                found.append(pd.DataFrame({"query_id": names[at + row], "id": ids[column], "score": scores[row, column]}))
            return pd.concat(found)

        pairs = left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInPandas(best, out)
        return top_k(pairs, k, by="query_id", tie="id")


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of `truth` (query_id, id) that is in `found`."""
    n = truth.count()
    return truth.join(found.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi").count() / n if n else 1.0
