"""Language identification by a bidirectional gated recurrent network over bytes.

Training is plain numpy: backpropagation through time on a bounded sample of labelled rows, on the
driver. Labelling runs in tasks: every byte position of every text gets label probabilities, and a
document's probability is the mean over its positions. Gates use piecewise linear sigmoids, so a
step costs a table lookup, a small product and clips.
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

PAD = 256  #: a symbol that leaves the state as it is


@dataclass
class Network:
    labels: list[str]
    E: np.ndarray  # direction, gate (reset, update, candidate), symbol, hidden
    U: np.ndarray  # direction, gate, hidden, hidden
    W: np.ndarray  # direction, hidden, label
    b: np.ndarray  # label

    def states(self, d: int, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states of direction `d` for symbols x (time, window): (time, window, hidden)."""
        E, U = self.E[d], self.U[d]
        out = np.empty((*x.shape, U.shape[1]), np.float32)
        h = np.zeros((x.shape[1], U.shape[1]), np.float32)
        for t, symbols in enumerate(x):
            g = E.take(symbols, axis=1)
            a = h @ U
            g[:2] += a[:2]
            np.clip(g[:2], 0, 1, out=g[:2])
            n = g[2]
            n += g[0] * a[2]
            np.clip(n, -1, 1, out=n)
            if keep is not None:
                keep.append((h, g, a[2]))
            h = np.add(g[1] * (h - n), n, out=out[t])
        return out


def _reversed(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Row t of window w is its row length - 1 - t; the rest is left where it is."""
    t = np.arange(len(x))[:, None]
    return np.where(t < lengths, lengths - 1 - t, t)


def train(texts: list[bytes], targets: np.ndarray, labels: list[str], hidden: int = 8, steps: int = 360, batch: int = 96, span: int = 96, rate: float = 0.02, seed: int = 7) -> Network:
    """Fits the network so that every position of a text says the text's label.

    Texts are read whole, in windows of `span` bytes; a batch has as many of each label. There are as many
    steps as it takes to read every window once, `steps` at least.
    """
    rng = np.random.default_rng(seed)
    k = len(labels)
    net = Network(
        labels, rng.normal(0, 0.15, (2, 3, 257, hidden)).astype(np.float32), rng.normal(0, 0.25, (2, 3, hidden, hidden)).astype(np.float32),
        rng.normal(0, 0.3, (2, hidden, k)).astype(np.float32), np.zeros(k, np.float32),
    )
    net.E[:, 0] += 0.5
    net.E[:, 1] += 0.7
    net.E[:, 1, PAD] = 1e4
    if not len(texts) or k < 2:
        return net
    cuts = [[t[i : i + span] for t, y in zip(texts, targets, strict=True) if y == label for i in range(0, len(t), span)] for label in range(k)]
    share = max(1, batch // k)
    batch, steps = share * k, max(steps, -(-max(map(len, cuts)) // share))
    queues: list[list[int]] = [[] for _ in range(k)]
    owner = np.repeat(np.arange(k), share)
    values = [net.E, net.U, net.W, net.b]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    for step in range(1, steps + 1):
        x = np.full((span, batch), PAD, np.int64)
        lengths = np.zeros(batch, np.int64)
        for j, label in enumerate(owner.tolist()):
            if not queues[label]:
                queues[label] = rng.permutation(len(cuts[label])).tolist()
            part = np.frombuffer(cuts[label][queues[label].pop()], np.uint8)
            x[: len(part), j], lengths[j] = part, len(part)
        back = _reversed(x, lengths)
        mask = (np.arange(span)[:, None] < lengths).astype(np.float32) / max(1, lengths.sum())
        xs = [x, np.take_along_axis(x, back, 0)]
        kept: list[list] = [[], []]
        hs = [net.states(d, xs[d], kept[d]) for d in (0, 1)]
        rows = np.arange(batch)[None, :]
        logits = hs[0] @ net.W[0] + (hs[1] @ net.W[1])[back, rows] + net.b
        p = np.exp(logits - logits.max(-1, keepdims=True))
        p /= p.sum(-1, keepdims=True)
        p[:, np.arange(batch), owner] -= 1
        d_logits = (p * mask[..., None]).astype(np.float32)
        grads = [np.zeros_like(v) for v in values]
        grads[3] += d_logits.sum((0, 1))
        for d in (0, 1):
            dl = d_logits if d == 0 else d_logits[back, rows]
            grads[2][d] = np.tensordot(hs[d], dl, ([0, 1], [0, 1]))
            outer = dl @ net.W[d].T
            U, dh = net.U[d], np.zeros((batch, hidden), np.float32)
            dG = np.empty((span, 3, batch, hidden), np.float32)
            for t in range(span - 1, -1, -1):
                before, g, a2 = kept[d][t]
                r, z, n = g
                dh += outer[t]
                dn = dh * (1 - z) * (np.abs(n) < 1)
                dz = dh * (before - n) * ((z > 0) & (z < 1))
                dr = dn * a2 * ((r > 0) & (r < 1))
                dA = np.stack((dr, dz, dn * r))
                dG[t] = (dr, dz, dn)
                grads[1][d] += before.T @ dA
                dh = dh * z + (dA @ U.transpose(0, 2, 1)).sum(0)
            flat = xs[d].ravel()
            for gate in range(3):
                for j in range(hidden):
                    grads[0][d, gate, :, j] = np.bincount(flat, dG[:, gate, :, j].ravel(), 257)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        pace = rate * min(1.0, 3 * (1 - step / (steps + 1)))
        for v, g, (m1, m2) in zip(values, grads, moments, strict=True):
            g *= min(1.0, 1.0 / (norm + 1e-9))
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            v -= pace * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        net.E[:, :, PAD] = 0
        net.E[:, 1, PAD] = 1e4
    return net


def label_positions(net: Network, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: int = 480, context: int = 16, batch: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Label probabilities of every byte position, for texts at `starts` in `raw`.

    Long texts are read in windows of `window` positions with `context` more on either side. Yields
    (text, first position, counts, probabilities (label, time, window) with zeros outside the counted
    positions) for groups of windows.
    """
    per = -(-lengths // window)
    text = np.repeat(np.arange(len(lengths)), per)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * window
    lead = np.minimum(first, context)
    counted = np.minimum(window, lengths[text] - first)
    size = np.minimum(lead + window + context, lengths[text] - first + lead)
    at = starts[text] + first - lead
    order = np.argsort(-size, kind="stable")
    for g in range(0, len(order), batch):
        o = order[g : g + batch]
        t = np.arange(size[o[0]])[:, None]
        inside = t < size[o]
        x = np.where(inside, raw[np.minimum(at[o] + t, len(raw) - 1)].astype(np.intp), PAD)
        back = np.where(inside, size[o] - 1 - t, t)
        same = bool(inside.all())
        k, hidden = net.W.shape[2], net.W.shape[1]
        logits = (net.W[0].T @ net.states(0, x).reshape(-1, hidden).T).reshape(k, *x.shape)
        other = (net.W[1].T @ net.states(1, x[::-1] if same else np.take_along_axis(x, back, 0)).reshape(-1, hidden).T).reshape(k, *x.shape)
        logits += other[:, ::-1] if same else other[:, back, np.arange(len(o))]
        logits += net.b[:, None, None]
        logits -= logits.max(0)
        np.exp(logits, out=logits)
        logits /= logits.sum(0)
        logits *= (t >= lead[o]) & (t < lead[o] + counted[o])
        yield text[o], first[o], counted[o], logits


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "ignore"))


def training_sample(docs: DataFrame, usable, text_col: str, label_col: str, per_label: int, bound: int, least: int) -> tuple[list[bytes], list[str]]:
    """Whole texts of about min(`per_label`, max(`least`, `bound` / labels)) rows of every label, twice that at most, chosen by a hash of the text.

    `usable` is a predicate on `docs`.
    """
    rows = docs.where(usable & F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & (F.col(text_col) != "")).select(
        F.col(text_col).cast("string").alias("t"), F.col(label_col).cast("string").alias("y")
    )
    counts = rows.groupBy("y").count()
    labels = counts.count()
    if not labels:
        return [], []
    quota, million = min(per_label, max(least, bound // labels)), 1_000_000
    # As many labels as the network has outputs.
    shares = counts.select("y", F.least(F.lit(million), F.ceil(F.lit(quota * million) / F.col("count"))).alias("share"))
    some = rows.join(F.broadcast(shares), "y").where(F.pmod(F.xxhash64("t", F.lit(11)), F.lit(million)) < F.col("share"))
    got = some.select("y", F.xxhash64("t").alias("h"), "t").orderBy("h", "y").limit(2 * quota * labels).collect()
    got.sort(key=lambda r: (r.h, r.y, r.t))
    return [r.t.encode() for r in got], [r.y for r in got]


def fit(docs: DataFrame, usable, text_col: str = "text", label_col: str = "lang", per_label: int = 200, bound: int = 12_800, least: int = 20, **settings) -> Network:
    """The network fitted on a sample of about `per_label` whole texts for each label (twice that at the very most).

    Every label is learnt. Where they would make more than `bound` rows together, each has its equal part
    of those, but `least` rows.
    """
    texts, names = training_sample(docs, usable, text_col, label_col, per_label, bound, least)
    labels = sorted(set(names))
    return train(texts, np.array([labels.index(n) for n in names], np.int64), labels, **settings)


def identify_language(docs: DataFrame, net: Network, text_col: str = "text", keep: tuple[str, ...] | None = None, runs: bool = False, result_col: str = "language") -> DataFrame:
    """The columns `keep` of `docs` (by default all) and struct `result_col`: `label`, `score`, and with `runs` `runs`.

    `label` is `und`, with score 0, for a text that is null, empty or has no letter, and where nothing
    was learnt. `score` is the pooled probability of the label. `runs` lists (start, end, label) ranges
    of byte positions with one label, the whole text over. Every byte of every text is labelled, in
    windows; memory is bounded by the batch and one text. Repeated rows get the same result; a
    column named like `result_col` gives way to it; an empty table gives an empty result.
    """
    kept = named(docs, keep, (result_col,))
    rows = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(kept)], docs[text_col].cast("string").alias("text"))
    fields = [T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())]
    run = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())])
    kind = pa.struct([("label", pa.string()), ("score", pa.float64())] + [("runs", pa.list_(run))] * runs)
    if runs:
        fields.append(T.StructField("runs", T.ArrayType(T._parse_datatype_string("start bigint, end bigint, label string"))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text"):
                raw, starts, lengths = text_bytes(b.column(len(kept)))
                pooled = np.zeros((max(1, len(net.labels)), len(lengths)))
                marks: list[list] = [[] for _ in lengths]
                for text, first, _, p in label_positions(net, raw, starts, lengths) if net.labels else ():
                    for i, sums in enumerate(p.sum(1)):
                        pooled[i] += np.bincount(text, sums, len(lengths))
                    if runs:
                        best, there = p.argmax(0), p.any(0)
                        for j, (doc, at) in enumerate(zip(text.tolist(), first.tolist(), strict=True)):
                            marks[doc].append((at, best[there[:, j], j]))
                pooled /= np.maximum(lengths, 1)
                best = pooled.argmax(0)
                out = []
                for i, n in enumerate(lengths.tolist()):
                    known = bool(net.labels) and n > 0 and has_letter(raw[starts[i] : starts[i] + n].tobytes())
                    row = {"label": net.labels[best[i]] if known else "und", "score": float(min(1.0, pooled[best[i], i])) if known else 0.0}
                    if runs:
                        row["runs"] = runs_of(net.labels, marks[i])
                    out.append(row)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, kind)], [*b.schema.names[:-1], "language"])

    return rows.mapInArrow(scan, T.StructType([*rows.schema.fields[:-1], T.StructField("language", T.StructType(fields))])).toDF(*kept, result_col)


def runs_of(labels: list[str], marks: list[tuple[int, np.ndarray]]) -> list[dict]:
    """Ranges of equal labels from (first position, label numbers) of a text's windows."""
    if not marks:
        return []
    line = np.concatenate([m for _, m in sorted(marks, key=lambda m: m[0])])
    cuts = (np.flatnonzero(np.diff(line)) + 1).tolist()
    return [{"start": a, "end": z, "label": labels[line[a]]} for a, z in zip([0, *cuts], [*cuts, len(line)], strict=True)]
