"""A stored inverted index for keyword search: postings by term, upserts, and block bounds that let a search stop early.

The index is a folder of generations. A generation holds the postings of the documents that it added or
changed, one row a term and block of documents with its bounds, in folders by term and sorted, so a search reads
the asked terms' folders and row groups only; changes of document frequency; and what it replaced. A task
writes the blocks of the documents that it reads, so neither texts nor postings are shuffled. A generation's
facts are written last: readers see generations that have them, so a failed write is never seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import text as X
from wardline.operators.retrieval import _tokens, top_k

#: Replaced documents up to which their ids are broadcast (about 20 bytes each).
FEW = 1_000_000


#: Documents of a block, and words after which it ends before it has them.
IN_BLOCK, WORDS = 256, 1_000_000

Batches = Iterator[pa.RecordBatch]


def _firsts(key: np.ndarray) -> np.ndarray:
    """Where the values of a sorted array change."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def _counted(gen: int, in_block: int, words: int = WORDS) -> Callable[[Batches], Batches]:
    """(id, words) to (id, length, block, t): the different words of each document with their number, in order of the word.

    Each Arrow batch's documents are dealt to blocks in order of length, so that a block's bounds are tight. A block is
    numbered by generation, task and place, so no two blocks have the same number.
    """

    def count(batches: Batches) -> Batches:
        from pyspark import TaskContext

        block = (gen << 40) + (TaskContext.get().partitionId() << 20)
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            sizes = lists.value_lengths().to_numpy()
            order = np.argsort(sizes, kind="stable")
            ends, start = np.cumsum(sizes[order], dtype=np.int64), 0
            while start < len(order):
                full = np.searchsorted(ends, (ends[start - 1] if start else 0) + words, "right")
                at = order[start : max(start + 1, min(start + in_block, int(full)))]
                n, start = len(at), start + len(at)
                coded = lists.take(pa.array(at)).flatten().dictionary_encode()
                by_word = pc.array_sort_indices(coded.dictionary).to_numpy()
                v = max(len(by_word), 1)
                rank = np.empty(v, np.int64)
                rank[by_word] = np.arange(len(by_word))
                key = np.sort(np.repeat(np.arange(n), sizes[at]) * v + rank[coded.indices.to_numpy()])
                first = _firsts(key)
                terms = coded.dictionary.take(pa.array(by_word[key[first] % v]))
                pairs = pa.StructArray.from_arrays([terms, pa.array(np.diff(first, append=len(key)).astype(np.int32))], ["term", "tf"])
                t = pa.ListArray.from_arrays(pa.array(np.searchsorted(key[first] // v, np.arange(n + 1)).astype(np.int32)), pairs)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(sizes[at], pa.int32()), pa.array(np.full(n, block)), t], ["id", "length", "block", "t"])
                block += 1

    return count


def _inverted(batches: Batches) -> Batches:
    """(id, length, block, t) to a row a term and block: its largest tf, least length and number of documents, and their ids, tfs and lengths.

    A block that is cut between batches has two rows of a term, which searches take together.
    """
    for whole in batches:
        starts = [*_firsts(whole.column(2).to_numpy()), whole.num_rows]
        for start, end in zip(starts, starts[1:]):
            b = whole.slice(start, end - start)
            ids, t = b.column(0), b.column(3)
            pairs = t.flatten()
            coded = pairs.field(0).dictionary_encode()
            n = max(len(pairs), 1)
            key = np.sort(coded.indices.to_numpy().astype(np.int64) * n + np.arange(len(pairs)))
            code, place = key // n, key % n
            first = _firsts(code)
            if not len(first):
                continue
            doc = np.repeat(np.arange(b.num_rows), t.value_lengths().to_numpy())[place]
            tfs, lengths = pairs.field(1).to_numpy()[place], b.column(1).to_numpy()[doc]
            offsets = pa.array(np.append(first, len(key)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (ids.take(pa.array(doc)), pa.array(tfs), pa.array(lengths))]
            bounds = [pa.array(np.maximum.reduceat(tfs, first)), pa.array(np.minimum.reduceat(lengths, first)), pa.array(np.diff(first, append=len(key)))]
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary.take(pa.array(code[first])), pa.array(np.full(len(first), b.column(2)[0].as_py())), *bounds, *lists], ["term", "block", "tf", "length", "df", "ids", "tfs", "lengths"])


_BOUNDS, _DOCS = "term string, block long, tf int, length int, df long", "ids array<{}>, tfs array<int>, lengths array<int>"


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= FEW else ids


class Index:
    """Postings of documents (id, text) below a folder that executors share."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "doc_id", parts: int = 64):
        self.spark, self.folder, self.key, self.parts = spark, folder.rstrip("/"), key, parts

    def _generations(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/facts")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return []
        return sorted(r[0] for r in self.spark.read.parquet(f"{self.folder}/facts").select("gen").distinct().collect())

    def _id(self) -> str:
        return self.spark.read.parquet(f"{self.folder}/words").schema["id"].dataType.simpleString()

    def _read(self, name: str) -> DataFrame:
        """A table of the index without what an unfinished write has left."""
        columns = {"postings": f"{_BOUNDS}, {_DOCS}, gen int, part int", "frequencies": "term string, df long, gen int, part int"}
        reader = self.spark.read.schema(columns[name].format(self._id())) if name in columns else self.spark.read
        return reader.parquet(f"{self.folder}/{name}").where(F.col("gen").isin(self._generations()))

    def _part(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.parts)).cast("int")

    def upsert(self, docs: DataFrame, text: str = "text", drop: bool = False) -> int:
        """Adds documents, or replaces those of the same id; of rows that repeat an id the least by text stays. Returns the generation.

        With `drop` they are only taken out. Null texts are empty, null ids are left out. Of the stored index only
        the lists of words of replaced documents are read.
        """
        made = self._generations()
        gen = made[-1] + 1 if made else 0
        place = lambda name: f"{self.folder}/{name}/gen={gen}"
        content = F.coalesce(docs[text].cast("string"), F.lit(""))
        given = docs.where(docs[self.key].isNotNull()).select(docs[self.key].alias("id"), content.alias("text"))
        words_of = lambda rows: rows.select("id", X.tokens(F.col("text")).alias("t"))
        kind = given.schema["id"].dataType.simpleString()
        lists = words_of(self._one_a_key(given).where(F.lit(not drop))).mapInArrow(_counted(gen, IN_BLOCK), f"id {kind}, length int, block long, t array<struct<term: string, tf: int>>")
        lists.write.mode("overwrite").parquet(place("words"))
        words = self.spark.read.parquet(place("words"))
        rows = words.select("id", "length", "block", "t").mapInArrow(_inverted, f"{_BOUNDS}, {_DOCS.format(kind)}")
        rows.withColumn("part", self._part(F.col("term"))).sortWithinPartitions("part", "term", "block").write.mode("overwrite").partitionBy("part").parquet(place("postings"))
        added = self.spark.read.schema("term string, df long, part int").parquet(place("postings")).select("term", "df")
        gone_n, gone_length = 0, 0
        if made:
            live = self._live(self._read("words")).join(given.select("id"), "id", "left_semi")
            live.select("id", F.col("gen").alias("was")).write.mode("overwrite").parquet(place("gone"))
            gone = self.spark.read.parquet(place("gone")).withColumnRenamed("was", "gen")
            old = self._read("words").join(_few(gone), ["id", "gen"], "left_semi")
            facts = old.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("l")).first()
            gone_n, gone_length = facts.n, facts.l
            lost = old.select(F.explode("t.term").alias("term")).groupBy("term").agg((-F.count("*")).alias("df"))
            added = added.unionByName(lost)
        else:
            words.select("id", F.lit(0).alias("was")).where("false").write.mode("overwrite").parquet(place("gone"))
        added.groupBy(self._part(F.col("term")).alias("part"), "term").agg(F.sum("df").alias("df")).sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(place("frequencies"))
        sums = words.agg((F.count("*") - gone_n).alias("n"), (F.coalesce(F.sum("length"), F.lit(0)) - gone_length).alias("length"))
        sums.coalesce(1).write.mode("overwrite").parquet(place("facts"))
        return gen

    def _one_a_key(self, given: DataFrame) -> DataFrame:
        """Of rows (id, text) that repeat an id the least; only those are shuffled, or all if over FEW ids repeat."""
        again = given.groupBy("id").count().where("count > 1").select("id")
        n = again.count()
        if not n:
            return given
        if n > FEW:
            return given.groupBy("id").agg(F.min("text").alias("text"))
        again = F.broadcast(again)
        return given.join(again, "id", "left_anti").unionByName(given.join(again, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))

    def delete(self, ids: DataFrame) -> int:
        """Takes documents out by id; ids that the index doesn't have change nothing."""
        made = self._generations()
        if not made:
            raise LookupError("the index is empty")
        return self.upsert(ids.select(self.key).withColumn("text", F.lit("")), drop=True)

    def _live(self, rows: DataFrame, key: str = "id") -> DataFrame:
        """`rows` (id, gen) of documents that no later generation replaced."""
        gone = self._read("gone").select(F.col("id").alias(key), F.col("was").alias("gen"))
        return rows.join(_few(gone), [key, "gen"], "left_anti")

    def postings(self, terms: list[str]) -> DataFrame:
        """(id, term, tf, length, block) of the terms, of live documents; reads the terms' partitions only."""
        return self._listed(self._asked("postings", terms))

    def _listed(self, rows: DataFrame) -> DataFrame:
        """The postings of live documents in rows of blocks."""
        each = rows.select(*[c for c in rows.columns if c not in ("tf", "length", "ids", "tfs", "lengths", "df")], F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("d"))
        return self._live(each.select("*", F.col("d.ids").alias("id"), F.col("d.tfs").alias("tf"), F.col("d.lengths").alias("length"))).drop("d", "gen", "part")

    def _asked(self, name: str, terms: list[str]) -> DataFrame:
        places = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(self._part(F.col("t"))).distinct().collect()]
        return self._read(name).where(F.col("part").isin(places) & F.col("term").isin(terms))

    def search(self, queries: list[tuple[int, str]], k: int | None = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """(query_id, key, score[, rank]): the `k` best by BM25 (see `retrieval.keyword_scores`, whose scores these are), or all with `k` None.

        With `k`, the blocks that promise most, by the bounds of their terms, are scored first; then only those whose
        bound reaches the k-th score found. Ties go by id. Queries are a caller's list.
        """
        asked = {q: _tokens(text) for q, text in queries}
        vocabulary = sorted({t for ts in asked.values() for t in ts})
        kind = self._read("words").schema["id"].dataType if self._generations() else self.spark.range(0).schema["id"].dataType
        if not vocabulary or not self._generations():
            out = self.spark.createDataFrame([], "query_id int, score double").withColumn(self.key, F.lit(None).cast(kind))
            return out.select("query_id", self.key, "score", *([F.lit(0).alias("rank")] if k else []))
        facts = self._read("facts").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).first()
        df = {r.term: r.df for r in self._asked("frequencies", vocabulary).groupBy("term").agg(F.sum("df").alias("df")).collect()}
        idf = {t: max(0.0, (facts.n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5)) for t in vocabulary}
        mean = max(facts.length / facts.n if facts.n else 0.0, 1.0)
        weights = self.spark.createDataFrame([(q, t, idf[t] * ts.count(t)) for q, ts in asked.items() for t in sorted(set(ts))], "query_id int, term string, weight double")  # the caller's words
        impact = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean))

        def scored(postings: DataFrame) -> DataFrame:
            return postings.join(F.broadcast(weights), "term").groupBy("query_id", F.col("id").alias(self.key)).agg(F.sum(impact).alias("score"))

        if k is None:
            return scored(self.postings(vocabulary))
        # A bound of a block holds for all generations together, and for documents that are gone.
        stored = self._asked("postings", vocabulary)
        bounds = stored.groupBy("term", "block").agg(F.max("tf").alias("tf"), F.min("length").alias("length"), F.sum("df").alias("df"))
        promise = bounds.join(F.broadcast(weights), "term").groupBy("query_id", "block").agg(F.sum(impact).alias("bound"), F.max("df").alias("n"))
        first = top_k(promise.withColumnRenamed("bound", "score"), 8, by="query_id", tie="block").select("query_id", "block")
        seeds = self._listed(stored.join(F.broadcast(first), "block")).join(F.broadcast(weights), ["query_id", "term"]).groupBy("query_id", "id").agg(F.sum(impact).alias("score"))
        least = top_k(seeds, k, by="query_id", tie="id").groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k)
        limits = {r.query_id: r.least for r in least.collect()}
        floors = self.spark.createDataFrame([(q, limits.get(q, 0.0)) for q in asked], "query_id int, least double")
        # Blocks that can reach the limit: as few as the table of blocks, a fraction of the documents.
        useful = promise.join(F.broadcast(floors), "query_id").where(F.col("bound") >= F.col("least") * (1 - 1e-9)).select("query_id", "block")
        self.useful_blocks = useful
        rows = self._listed(stored.join(useful, "block")).join(F.broadcast(weights), ["query_id", "term"]).groupBy("query_id", F.col("id").alias(self.key)).agg(F.sum(impact).alias("score"))
        return top_k(rows, k, by="query_id", tie=self.key)

    def compact(self) -> int:
        """Rewrites the live documents' words as one generation; earlier ones stay in the folder until it is removed, but are no longer read."""
        words = self._live(self._read("words")).select("id", F.array_join(F.flatten(F.transform("t", lambda w: F.array_repeat(w["term"], w["tf"]))), " ").alias("text"))
        fresh = Index(self.spark, f"{self.folder}-next", self.key, self.parts)
        fresh.upsert(words.withColumnRenamed("id", self.key) if self.key != "id" else words)
        self.folder = fresh.folder
        return 0
