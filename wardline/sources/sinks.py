"""Writers: patient tables as CSV, JSON or a summary, and document collections as versioned Parquet.

A collection is a folder of versions; a version is a folder of Parquet and a log row. Readers see the
last version of the log, so a failed write is never seen, and a rollback is one more log row.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "version bigint, path string, rows bigint, checksum bigint, note string"


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the session's checkpoint folder, or one of the default file system; a temporary one with a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    return (named or (f"{tempfile.gettempdir()}/wardline-shared" if local else "wardline-shared")).rstrip("/")


def as_records(rows: DataFrame, digits: int = 2) -> DataFrame:
    """(json): every row as a JSON object, doubles rounded."""
    cleaned = [F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in rows.schema]
    return rows.select(F.to_json(F.struct(*cleaned), {"ignoreNullFields": "false"}).alias("json"))


def save_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; arrays become JSON text."""
    flat = [F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in rows.schema]
    rows.select(*flat).write.option("header", True).mode("overwrite").csv(path)


def save_json(rows: DataFrame, path: str) -> None:
    as_records(rows).write.mode("overwrite").text(path)


class Collection:
    """Documents of one collection by a key column."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "id"):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key

    def log(self) -> DataFrame:
        empty = self.spark.createDataFrame([], LOG)
        if not self._exists(f"{self.folder}/log"):
            return empty
        return self.spark.read.schema(LOG).parquet(f"{self.folder}/log")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def head(self):
        """The log row that readers follow, or None."""
        return self.log().orderBy(F.desc("version")).first()

    def read(self) -> DataFrame | None:
        last = self.head()
        return None if last is None else self.spark.read.parquet(last.path)

    def commit(self, rows: DataFrame, note: str) -> int:
        """Writes a version, then its log row."""
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        facts = self.spark.read.parquet(path).agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(self.key)), F.lit(0)).alias("x")).first()
        return self._logged(path, facts.n, facts.x, note)

    def _logged(self, path: str, n: int, x: int, note: str) -> int:
        last = self.head()
        version = 1 if last is None else last.version + 1
        self.spark.createDataFrame([(version, path, n, x, note)], LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")
        return version

    def upsert(self, rows: DataFrame) -> int:
        """Rows replace those of the same key; of equal keys among them the one whose JSON form is last stays."""
        rest = [c for c in rows.columns if c != self.key]
        new = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.to_json(F.struct(*rest))).alias("r")).select(self.key, "r.*") if rest else rows.distinct()
        old = self.read()
        return self.commit(new if old is None else old.join(new, self.key, "left_anti").unionByName(new, allowMissingColumns=True), "upsert")

    def delete(self, keys: DataFrame) -> int:
        old = self.read()
        if old is None:
            raise LookupError("the collection is empty")
        return self.commit(old.join(keys, self.key, "left_anti"), "delete")

    def get(self, keys: DataFrame) -> DataFrame:
        old = self.read()
        if old is None:
            raise LookupError("the collection is empty")
        return old.join(keys, self.key, "left_semi")

    def rollback(self, version: int) -> int:
        """Makes an older version's data the last again."""
        row = self.log().where(F.col("version") == version).first()
        if row is None:
            raise LookupError(f"no version {version}")
        return self._logged(row.path, row.rows, row.checksum, f"rollback to {version}")
