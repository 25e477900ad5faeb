"""Quality classifier: a byte-level convolutional network in numpy.

A text is read in overlapping chunks that cover it whole. Learned filters of 8 bytes slide over a
chunk in steps of 4 (first convolution as one table per filter position, so a step is a lookup and
an add), the strongest response of each filter is the chunk's vector, and a document's probability
comes from the mean, the largest and the smallest of its chunks' vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.common import named, pieces, text_bytes

PAD, CHUNK, STEP, WIDTH, STRIDE = 256, 256, 224, 8, 4  # bytes: chunk, chunk step, filter width and step
SPOTS = (CHUNK - WIDTH) // STRIDE + 1


@dataclass
class Network:
    tables: np.ndarray  # filter position, symbol, filter
    w: np.ndarray  # mean, largest, smallest of each filter
    b: float

    def responses(self, x: np.ndarray) -> np.ndarray:
        """Filter responses (chunk, spot, filter) of chunks of symbols (chunk, CHUNK)."""
        total = self.tables[0].take(x[:, : CHUNK - WIDTH + 1 : STRIDE], axis=0)
        for j in range(1, WIDTH):
            total += self.tables[j].take(x[:, j : CHUNK - WIDTH + 1 + j : STRIDE], axis=0)
        return total


def cut_chunks(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, size) of every chunk; a text without bytes has one empty chunk."""
    per = np.maximum(1, -(-(lengths - (CHUNK - STEP)) // STEP))
    doc = np.repeat(np.arange(len(lengths)), per)
    first = (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * STEP
    return doc, starts[doc] + first, np.minimum(CHUNK, lengths[doc] - first)


def symbols(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    t = np.arange(CHUNK)
    if not len(raw):
        return np.full((len(at), CHUNK), PAD)
    return np.where(t < size[:, None], raw[np.minimum(at[:, None] + t, len(raw) - 1)].astype(np.intp), PAD)


def pool(doc: np.ndarray, top: np.ndarray, n: int) -> np.ndarray:
    """(document, 3 * filters): mean, largest and smallest chunk vectors; `doc` is sorted and without gaps."""
    at = np.searchsorted(doc, np.arange(n))
    counts = np.bincount(doc, minlength=n)[:, None]
    return np.hstack([np.add.reduceat(top, at) / counts, np.maximum.reduceat(top, at), np.minimum.reduceat(top, at)])


def sigmoid(y: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(y, -30, 30)))


def train(texts: list[bytes], y: np.ndarray, filters: int = 16, epochs: int = 14, batch: int = 64, rate: float = 0.01, seed: int = 3) -> Network:
    """Fits the network to whole texts, read in the chunks in which they are scored."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.25, (WIDTH, 257, filters)).astype(np.float32), rng.normal(0, 0.1, 3 * filters).astype(np.float32), 0.0)
    if not texts:
        return net
    if len(set(y.tolist())) < 2:
        net.w[:] = 0
        net.b = 4.0 if y[0] else -4.0
        return net
    share = float(y.mean())
    net.b = float(np.log(share / (1 - share)))
    joined = np.frombuffer(b"".join(texts) or b" ", np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    owner, at, size = cut_chunks(joined, np.cumsum(lengths) - lengths, lengths)
    begin = np.searchsorted(owner, np.arange(len(texts) + 1))
    values = [net.tables, net.w, np.array([net.b], np.float32)]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    step, last = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), batch):
            step += 1
            some = np.sort(order[k : k + batch])
            which = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in some])
            doc = np.searchsorted(some, owner[which])
            raw_top, seen = [], []
            for c in range(0, len(which), 512):  # bounds the memory of long texts: a filter's strongest spot is all that is kept of a chunk
                x = symbols(joined, at[which[c : c + 512]], size[which[c : c + 512]])
                r = net.responses(x)
                spot = r.argmax(1)
                raw_top.append(np.take_along_axis(r, spot[:, None], 1)[:, 0])
                seen.append(np.stack([np.take_along_axis(x, spot * STRIDE + j, 1) for j in range(WIDTH)]).astype(np.int16))
            raw_top, seen = np.concatenate(raw_top), np.concatenate(seen, axis=1)
            top = np.maximum(raw_top, 0)
            pooled = pool(doc, top, len(some))
            p = sigmoid(pooled @ values[1] + values[2][0])
            d = ((p - y[some]) / len(some)).astype(np.float32)
            gw, gb = pooled.T @ d, d.sum()
            counts = np.bincount(doc, minlength=len(some))
            w_mean, w_high, w_low = values[1].reshape(3, filters)
            g = d[doc, None] * w_mean / counts[doc, None]
            at_high, at_low = top == pooled[doc, filters : 2 * filters], top == pooled[doc, 2 * filters :]
            ties = np.add.reduceat(np.hstack([at_high, at_low]).astype(np.float32), np.searchsorted(doc, np.arange(len(some))))
            g += d[doc, None] * w_high * at_high / ties[doc, :filters] + d[doc, None] * w_low * at_low / ties[doc, filters:]
            g *= raw_top > 0
            gt = np.zeros_like(net.tables)
            for j in range(WIDTH):
                for f in range(filters):
                    gt[j, :, f] = np.bincount(seen[j, :, f], g[:, f], 257)
            pace = rate * min(1.0, 2 * (1 - step / (last + 1)))
            for v, grad, (m1, m2) in zip(values, (gt, gw.astype(np.float32), np.array([gb], np.float32)), moments, strict=True):
                m1 += 0.1 * (grad - m1)
                m2 += 0.01 * (grad * grad - m2)
                v -= pace * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
                if v is not values[2]:
                    v *= 1 - 0.02 * pace
    net.b = float(values[2][0])
    return net


def fit(docs: DataFrame, labels: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bound: int = 2000) -> Network:
    """The network fitted on at most `bound` labelled rows, chosen by a hash of the id, whose whole texts come to the driver.

    `usable` is a predicate over the id column, named `id_col`, of `labels`. The sample of ids and labels is
    broadcast; its bound does not depend on the data. Of rows that repeat an id, one stands for all (that with
    the least hash of its text), chosen before anything is collected.
    """
    marked = labels.where(usable & F.col(label_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).distinct()
    million = 1_000_000
    n = max(1, marked.count())
    key = F.pmod(F.xxhash64("i", F.lit(5)), F.lit(million))
    sample = marked.where(key < min(million, -(-2 * bound * million // n))).orderBy(F.xxhash64("i"), "i", "y").limit(bound)
    texts = docs.select(docs[id_col].alias("i"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("t"))
    picked = texts.join(F.broadcast(sample.distinct()), "i").groupBy("i", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t")).limit(bound)
    rows = sorted(((str(r.i), r.y, r.t.encode()) for r in picked.collect()))
    return train([t for _, _, t in rows], np.array([float(y == 1) for _, y, _ in rows], np.float32))


def score_quality(docs: DataFrame, net: Network, text_col: str = "text", keep: tuple[str, ...] | None = None, score_col: str = "quality_score") -> DataFrame:
    """The columns `keep` of `docs` (by default all) and `score_col`, the probability of label 1.

    A null text scores like an empty one (one chunk of padding). Whole texts are read, in chunks that
    overlap by 32 bytes; memory is bounded by the batch and one text. A column named like `score_col` gives
    way to it; repeated rows get equal scores; an empty table gives an empty result.
    """
    kept = named(docs, keep, (score_col,))
    rows = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(kept)], docs[text_col].cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text"):
                raw, starts, lengths = text_bytes(b.column(len(kept)))
                doc, at, size = cut_chunks(raw, starts, lengths)
                top = np.vstack([
                    np.maximum(net.responses(symbols(raw, at[k : k + 512], size[k : k + 512])).max(1), 0) for k in range(0, len(doc), 512)
                ])
                scores = sigmoid(pool(doc, top, len(lengths)).astype(np.float64) @ net.w.astype(np.float64) + net.b)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores)], [*b.schema.names[:-1], "score"])

    return rows.mapInArrow(scan, T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType())])).toDF(*kept, score_col)
