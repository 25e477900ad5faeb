"""Copy detection in image columns by local descriptors.

Images (binary PGM or PPM) are described at several scales: corners, an orientation from the intensity
centroid, and 256 binary tests turned by it. Copies of one byte string are folded into a class before
anything is described. Hamming tables, keyed by samples of the bits of two neighbouring corners, propose
pairs of images, whose corners are then all compared; a search that misses no pair of corners is there as
well (`exact`). Pairs of images are kept whose matches agree on scale, rotation and shift. Queries are described at more scales than
the images, so that copies of any size meet a level of the image. The tables hold a block of the queries;
images stream past them whole, so matches are voted on in the task that finds them and no pair is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from wardline.llm.common import cut

SCALES, QUERY_SCALES = (1.0, 0.75, 0.5), (1.25, 1.1, 1.0, 0.87, 0.75)
RADIUS, EDGE = 10, 11  # pixels: of the oriented patch, and kept from the border
APART, CONTRAST = 3, 20.0  # corners: strongest within so many pixels, and least response


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values of a binary PGM or PPM image of 8 bits; None for anything else."""
    if not data or data[:2] not in (b"P5", b"P6"):
        return None
    numbers, at = [], 2
    while len(numbers) < 3:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data)
            continue
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            return None
        numbers.append(int(data[at:end]))
        at = end
    w, h, top = numbers
    depth = 1 if data[:2] == b"P5" else 3
    body = data[at + 1 : at + 1 + w * h * depth]
    if not (0 < top < 256 and w and h) or len(body) < w * h * depth:
        return None
    pixels = np.frombuffer(body, np.uint8).astype(np.float32) * (255 / top)
    return pixels.reshape(h, w) if depth == 1 else pixels.reshape(h, w, 3) @ np.array([0.299, 0.587, 0.114], np.float32)


def encode(grey: np.ndarray) -> bytes:
    h, w = grey.shape
    return b"P5 %d %d 255\n" % (w, h) + np.clip(np.rint(grey), 0, 255).astype(np.uint8).tobytes()


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of side 2 r + 1, edges repeated; over the last two axes of (image, y, x)."""
    h, w = a.shape[-2:]
    a = np.pad(a, ((0, 0), (r, r), (r, r)), mode="edge")
    rows = a[:, :h].copy()
    for d in range(1, 2 * r + 1):
        rows += a[:, d : d + h]
    out = rows[:, :, :w].copy()
    for d in range(1, 2 * r + 1):
        out += rows[:, :, d : d + w]
    out *= np.float32(1 / (2 * r + 1) ** 2)
    return out


def _highest(a: np.ndarray, r: int) -> np.ndarray:
    """Maximum over squares of side 2 r + 1; r less on every side."""
    h, w = a.shape[-2] - 2 * r, a.shape[-1] - 2 * r
    rows = a[:, :h].copy()
    for d in range(1, 2 * r + 1):
        np.maximum(rows, a[:, d : d + h], out=rows)
    out = rows[:, :, :w].copy()
    for d in range(1, 2 * r + 1):
        np.maximum(out, rows[:, :, d : d + w], out=out)
    return out


def _resized(a: np.ndarray, scale: float) -> np.ndarray:
    def matrix(n: int) -> np.ndarray:
        m = max(1, round(n * scale))
        at = np.clip((np.arange(m) + 0.5) / scale - 0.5, 0, n - 1)
        low = np.minimum(at.astype(int), max(0, n - 2))
        out = np.zeros((m, n), np.float32)
        out[np.arange(m), low] = 1 - (at - low)
        out[np.arange(m), np.minimum(low + 1, n - 1)] += at - low
        return out

    return a if scale == 1 else matrix(a.shape[-2]) @ a @ matrix(a.shape[-1]).T


def _tests(seed: int = 19) -> np.ndarray:
    """256 pairs of points (pair, end, xy) inside the patch."""
    rng = np.random.default_rng(seed)
    points = rng.normal(0, RADIUS / 2, (4096, 2))
    return points[(points**2).sum(1) < (RADIUS - 0.5) ** 2][:512].reshape(256, 2, 2).astype(np.float32)


TESTS = _tests()


def describe(stack: np.ndarray, scales: tuple[float, ...] = SCALES) -> tuple[np.ndarray, ...]:
    """(image, x, y, scale, angle, descriptor bytes) of all corners of equally large images (image, y, x)."""
    found = []
    d = np.arange(-RADIUS, RADIUS + 1)
    disc = (d[:, None] ** 2 + d[None, :] ** 2) <= RADIUS**2
    dy, dx = (a[disc] for a in np.meshgrid(d, d, indexing="ij"))
    px, py = TESTS[..., 0], TESTS[..., 1]
    for scale in scales:
        level = np.ascontiguousarray(_resized(stack, scale), np.float32)
        h, w = level.shape[1:]
        if min(h, w) <= 2 * EDGE + 2:
            continue
        fine = _box(_box(level, 1), 1)
        gx, gy = np.zeros_like(fine), np.zeros_like(fine)
        gx[:, :, 1:-1] = fine[:, :, 2:] - fine[:, :, :-2]
        gy[:, 1:-1] = fine[:, 2:] - fine[:, :-2]
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        around = response[:, EDGE:-EDGE, EDGE:-EDGE]
        best = _highest(response[:, EDGE - APART : h - EDGE + APART, EDGE - APART : w - EDGE + APART], APART)
        n, y, x = np.nonzero((around >= best) & (around > CONTRAST))
        y, x = y + EDGE, x + EDGE
        at = ((n * h + y) * w + x)[:, None]
        patch = level.ravel()[at + (dy * w + dx)]
        angle = np.arctan2(patch @ dy.astype(np.float32), patch @ dx.astype(np.float32))
        c, s = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        off = np.rint(s * px + c * py).astype(np.int32) * w + np.rint(c * px - s * py).astype(np.int32)
        values = _box(_box(level, 2), 2).ravel()[at[..., None] + off]
        bits = np.packbits(values[..., 0] < values[..., 1], axis=1)
        found.append((n, x / scale, y / scale, np.full(len(n), scale), angle, bits))
    if not found:
        return (*[np.zeros(0)] * 5, np.zeros((0, 32), np.uint8))
    return tuple(np.concatenate(p) for p in zip(*found, strict=True))


#: One corner, as `corners` packs it.
CORNER = np.dtype([("x", "<f4"), ("y", "<f4"), ("scale", "<f4"), ("angle", "<f4"), ("bits", "<u8", 4)])


def corners(images: DataFrame, id_col: str, bytes_col: str, scales: tuple[float, ...] = SCALES) -> DataFrame:
    """(id, corners) of every decodable image that has corners: packed rows of `CORNER`."""
    rows = images.select(images[id_col].alias("id"), images[bytes_col].cast("binary").alias("data"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                shapes: dict[tuple, list] = {}
                for i, data in enumerate(b.column(1)):
                    if (grey := decode(data.as_py())) is not None:
                        shapes.setdefault(grey.shape, []).append((i, grey))
                for group in shapes.values():
                    n, x, y, scale, angle, bits = describe(np.stack([g for _, g in group]), scales)
                    if not len(n):
                        continue
                    packed = np.zeros(len(n), CORNER)
                    packed["x"], packed["y"], packed["scale"], packed["angle"] = x, y, scale, angle
                    packed["bits"] = np.ascontiguousarray(bits).view("<u8")
                    packed = packed[np.argsort(n, kind="stable")]
                    here, starts = np.unique(np.sort(n), return_index=True)
                    data = [part.tobytes() for part in np.split(packed, starts[1:])]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.array([i for i, _ in group])[here])), pa.array(data, pa.binary())], ["id", "corners"])

    return rows.mapInArrow(scan, T.StructType([rows.schema["id"], T.StructField("corners", T.BinaryType())]))


def _product(a: np.ndarray, b: np.ndarray, of_a: tuple, of_b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of members of the groups a[i] and b[i]; a side is (members in order of group, starts)."""
    na, nb = of_a[1][a + 1] - of_a[1][a], of_b[1][b + 1] - of_b[1][b]
    each = na * nb
    nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    width = np.repeat(nb, each)
    return of_a[0][np.repeat(of_a[1][a], each) + nth // width], of_b[0][np.repeat(of_b[1][b], each) + nth % width]


def _folded(bits: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Distinct descriptors, and who has each: (members in order of descriptor, starts)."""
    whole = np.ascontiguousarray(bits).view("V32").ravel()
    _, first, which = np.unique(whole, return_index=True, return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(np.bincount(which, minlength=len(first)))))
    return bits[first], (np.argsort(which, kind="stable"), starts)


def _near(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, distance: int) -> np.ndarray:
    """i * len(b) + j of the pairs of descriptors a[i], b[j] at `distance` or fewer bits."""
    near = np.bitwise_count(a[i] ^ b[j]).sum(axis=1, dtype=np.int32) <= distance
    return i[near].astype(np.int64) * len(b) + j[near]


def neighbours(c: np.ndarray, owner: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of every corner a and each of its `near` nearest corners b of the same image and level."""
    order = np.lexsort((c["scale"], owner))
    cuts = np.flatnonzero((np.diff(owner[order]) != 0) | (np.diff(c["scale"][order]) != 0)) + 1
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for group in np.split(order, cuts):
        k = min(near, len(group) - 1)
        for at in range(0, len(group) if k > 0 else 0, 1024):  # bounds the memory of images with many corners
            some = group[at : at + 1024]
            apart = (c["x"][some][:, None] - c["x"][group]) ** 2 + (c["y"][some][:, None] - c["y"][group]) ** 2
            apart[np.arange(len(some)), np.arange(at, at + len(some))] = np.inf
            first.append(np.repeat(some, k))
            second.append(group[np.argpartition(apart, k - 1, axis=1)[:, :k]].ravel())
    return np.concatenate(first), np.concatenate(second)


class Tables:
    """Hamming tables that propose pairs of images: two neighbouring corners of either have to agree on a sample of bits.

    A key is `bits` sampled bits of a corner's descriptor and as many of a neighbour's, with the neighbour's
    direction and orientation as seen from the corner, each in one of eight bins whose borders differ from
    table to table. Two corners agree by chance far less often than one, so the work is nearly in proportion to the images.
    All corners of the proposed pairs of images are then compared, so that what is found is what comparing everything finds.
    """

    def __init__(self, c: np.ndarray, owner: np.ndarray, distance: int, tables: int = 8, bits: int = 20, near: int = 3, agree: int = 2, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.distance, self.near, self.agree, self.corners = distance, near, agree, c
        self.masks = [(rng.permutation(256)[:bits], rng.permutation(256)[:bits], *rng.uniform(0, 2 * np.pi, 2)) for _ in range(tables)]
        self.starts = np.searchsorted(owner, np.arange(int(owner.max(initial=-1)) + 2))
        self.many = len(self.starts) - 1
        self.tables = []
        for keys, a in self.keys(c, owner):
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], owner[a[order]].astype(np.int64)))

    def keys(self, c: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        a, b = neighbours(c, owner, self.near)
        single = np.unpackbits(np.ascontiguousarray(c["bits"]).view(np.uint8).reshape(-1, 32), axis=1)
        aim = np.arctan2(c["y"][b] - c["y"][a], c["x"][b] - c["x"][a]) - c["angle"][a]
        turn = c["angle"][b] - c["angle"][a]
        for mine, other, u, v in self.masks:
            value = []
            for mask in (mine, other):
                packed = np.zeros((len(c), 8), np.uint8)
                part = np.packbits(single[:, mask], axis=1)
                packed[:, : part.shape[1]] = part
                value.append(packed.view(np.uint64).ravel())
            bins = [np.floor((x + w) * (4 / np.pi)).astype(np.int64).astype(np.uint64) & np.uint64(7) for x, w in ((aim, u), (turn, v))]
            yield (value[0][a] << np.uint64(34)) ^ (value[1][b] << np.uint64(6)) ^ (bins[0] << np.uint64(3)) ^ bins[1], a

    def proposals(self, c: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """image * queries + query of the pairs of images of which at least `agree` corners of the image met the query."""
        found = [np.zeros(0, np.int64)]
        for (keys, a), (values, theirs) in zip(self.keys(c, owner), self.tables, strict=True):
            low, high = np.searchsorted(values, keys), np.searchsorted(values, keys, side="right")
            n = high - low
            at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.unique(np.repeat(a, n) * self.many + theirs[at]))
        met = np.unique(np.concatenate(found))
        pairs, n = np.unique(owner[met // self.many].astype(np.int64) * self.many + met % self.many, return_counts=True)
        return pairs[n >= self.agree]

    def pairs(self, c: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, j) of all corners i and table's corners j of proposed images that are at `distance` or fewer bits."""
        starts = np.searchsorted(owner, np.arange(int(owner.max(initial=-1)) + 2))
        mine, other = np.ascontiguousarray(c["bits"]), np.ascontiguousarray(self.corners["bits"])
        i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for pair in self.proposals(c, owner).tolist():
            m, q = divmod(pair, self.many)
            b = other[self.starts[q] : self.starts[q + 1]]
            for at in range(starts[m], starts[m + 1], 1024):
                a = mine[at : min(at + 1024, starts[m + 1])]
                near = sum(np.bitwise_count(a[:, None, w] ^ b[None, :, w]).astype(np.int16) for w in range(4)) <= self.distance
                x, y = np.nonzero(near)
                i.append(x + at)
                j.append(y + self.starts[q])
        return np.concatenate(i), np.concatenate(j)


class Exact:
    """All corners at `distance` or fewer bits from given ones; none is missed.

    With p parts, p > distance / 2, some part of such a pair differs in at most one bit.
    """

    def __init__(self, c: np.ndarray, owner: np.ndarray, distance: int):
        bits = np.ascontiguousarray(c["bits"])
        self.distance, parts = distance, max(13, distance // 2 + 1)
        self.edges = [round(256 * i / parts) for i in range(parts + 1)]
        self.bits, self.members = _folded(bits)
        self.tables = []
        for value, width in self.parts(self.bits):
            self.tables.append((np.argsort(value, kind="stable").astype(np.int32), np.concatenate(([0], np.cumsum(np.bincount(value, minlength=1 << width)))).astype(np.int32)))

    def parts(self, bits: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        single = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8).reshape(-1, 32), axis=1)
        for a, b in zip(self.edges, self.edges[1:], strict=False):
            value = np.zeros(len(bits), np.int32)
            for j in range(a, b):
                value |= single[:, j].astype(np.int32) << (j - a)
            yield value, b - a

    def pairs(self, c: np.ndarray, owner: np.ndarray, at_once: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
        """(i, j) of all of the given corners i and the table's j, repeated descriptors included."""
        bits, members = _folded(np.ascontiguousarray(c["bits"]))
        found = []
        for (value, width), (order, starts) in zip(self.parts(bits), self.tables, strict=True):
            probes = value[:, None] ^ np.concatenate(([0], 1 << np.arange(width))).astype(np.int32)
            low = starts[probes].ravel()
            n = starts[probes + 1].ravel() - low
            hit = np.flatnonzero(n)
            low, n, who = low[hit].astype(np.int64), n[hit].astype(np.int64), hit // (width + 1)
            total = np.cumsum(n)
            cuts = np.unique(np.searchsorted(total, np.arange(at_once, total[-1], at_once))) if len(n) else []
            for s in np.split(np.arange(len(n)), cuts):
                k = np.arange(n[s].sum()) - np.repeat(np.cumsum(n[s]) - n[s], n[s])
                found.append(_near(bits, self.bits, np.repeat(who[s], n[s]), order[np.repeat(low[s], n[s]) + k], self.distance))
        both = np.unique(np.concatenate(found))
        return _product(both // max(1, len(self.bits)), both % max(1, len(self.bits)), members, self.members)


def consensus(image: np.ndarray, mine: np.ndarray, query: np.ndarray, asked: np.ndarray, i: np.ndarray, j: np.ndarray, votes: int) -> tuple[np.ndarray, ...]:
    """(image, query, votes) of the pairs of images of which at least `votes` corners j of the query agree on one bin.

    i and j are corners that match; `image` and `query` say whose they are. Bins are of scale, rotation and
    shift; a match votes for the two nearest of each, so that no border parts what agrees. A pair with
    fewer corners than `votes` can't have a bin with as many, and is left out first.
    """
    many, last = len(asked), int(query.max(initial=0)) + 1
    both = image[i] * last + query[j]
    seen = np.unique(image[i] * many + j)
    could, n = np.unique(seen // many * last + query[seen % many], return_counts=True)
    could = could[n >= votes]
    keep = np.isin(both, could)
    i, j = i[keep], j[keep]
    pair = np.searchsorted(could, both[keep])
    a, q = mine[i], asked[j]
    get = lambda r, c: r[c].astype(np.float64)
    turn, ratio = get(a, "angle") - get(q, "angle"), get(q, "scale") / get(a, "scale")
    sx = get(a, "x") - ratio * (np.cos(turn) * get(q, "x") - np.sin(turn) * get(q, "y"))
    sy = get(a, "y") - ratio * (np.sin(turn) * get(q, "x") + np.cos(turn) * get(q, "y"))
    r = np.rint(4 * np.log2(ratio)).astype(np.int64)
    low = lambda v, step: np.floor(v / step - 0.5).astype(np.int64)
    t, x, y = low(turn, 0.5), low(sx, 8.0), low(sy, 8.0)
    if not len(pair):
        return could[:0], could[:0], could[:0]
    r, x, y = r - r.min(), x - x.min(), y - y.min()
    wide, high = int(x.max()) + 2, int(y.max()) + 2
    base = pair * (int(r.max()) + 1) + r
    keys = [((base * 13 + (t + dt) % 13), x + dx, y + dy) for dt in (0, 1) for dx in (0, 1) for dy in (0, 1)]
    turned, which = np.unique(np.concatenate([k for k, _, _ in keys]), return_inverse=True)
    place = np.concatenate([xx * high + yy for _, xx, yy in keys])
    bins, bin_of = np.unique(which * (wide * high) + place, return_inverse=True)
    n = np.bincount(np.unique(bin_of * many + np.tile(j, 8)) // many, minlength=len(bins))
    best = np.zeros(len(could), np.int64)
    np.maximum.at(best, turned[bins // (wide * high)] // 13 // (int(r.max()) + 1), n)
    good = np.flatnonzero(best >= votes)
    return could[good] // last, could[good] % last, best[good]


def _blocks(asked: DataFrame, size: int) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and corners of the queries in blocks of about `size` corners."""
    ids, data, n = [], [], 0
    for row in asked.toLocalIterator():
        ids.append(row["id"])
        data.append(bytes(row["corners"]))
        n += len(data[-1]) // CORNER.itemsize
        if n >= size:
            yield ids, data
            ids, data, n = [], [], 0
    if ids:
        yield ids, data


def find_copies(
    queries: DataFrame, images: DataFrame, id_col: str, bytes_col: str, distance: int = 24, votes: int = 5, folded: bool = False, exact: bool = False, block: int = 1 << 18,
) -> DataFrame:
    """(query_id, class_id, votes): for every query image the classes of equal images that it is a cropped or edited copy of.

    `images` holds (id, bytes), and `classes` gives its membership; with `folded` it has one row a class
    already. Corners of images and queries match within `distance` bits. Pairs of images are proposed by
    `Tables`; a copy has many corners, so few copies are missed. With `exact` every corner is searched for
    among all. Nothing is capped. Corners of both sides are checkpointed; `block` corners of the
    queries (48 bytes each) are broadcast at a time. Images that are null or can't be decoded match nothing.
    Repeated rows are one class; a null id among `images` names no class by itself. Empty tables give an
    empty result. Only the two named columns are read.
    """
    spark = images.sparkSession
    if not folded:
        first = classes(images, id_col, bytes_col).select(F.col("class_id").alias(id_col)).distinct()
        images = images.select(id_col, bytes_col).join(first, id_col, "left_semi").dropDuplicates([id_col])
    index = cut(corners(images, id_col, bytes_col))
    asked = cut(corners(queries, id_col, bytes_col, QUERY_SCALES))
    fields = T.StructType([T.StructField("query_id", asked.schema["id"].dataType), T.StructField("class_id", index.schema["id"].dataType), T.StructField("votes", T.LongType())])
    kind, found = to_arrow_type(asked.schema["id"].dataType), []
    for ids, data in _blocks(asked, block):
        tables = spark.sparkContext.broadcast((ids, data))

        def match(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            ids, data = tables.value
            names = pa.array(ids, kind)
            theirs = np.frombuffer(b"".join(data), CORNER)
            query = np.repeat(np.arange(len(data)), [len(d) // CORNER.itemsize for d in data])
            search = None
            for whole in batches:
                for at in range(0, whole.num_rows, 32):
                    b = whole.slice(at, 32)
                    search = search or (Exact if exact else Tables)(theirs, query, distance)
                    given = [d.as_py() for d in b.column(1)]
                    mine = np.frombuffer(b"".join(given), CORNER)
                    image = np.repeat(np.arange(len(given)), [len(d) // CORNER.itemsize for d in given])
                    m, q, n = consensus(image, mine, query, theirs, *search.pairs(mine, image), votes)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), b.column(0).take(pa.array(m)), pa.array(n, pa.int64())], ["query_id", "class_id", "votes"])

        found.append(cut(index.mapInArrow(match, fields)))
        tables.destroy()
    out = spark.createDataFrame([], fields)
    for part in found:
        out = out.union(part)
    return out.groupBy("query_id", "class_id").agg(F.max("votes").alias("votes"))


def classes(images: DataFrame, id_col: str, bytes_col: str) -> DataFrame:
    """(id, class_id) of every image row: the smallest id with the same bytes; null bytes have no class."""
    rows = images.select(F.col(id_col).alias("id"), F.sha2(F.col(bytes_col), 256).alias("h"))
    least = rows.where("h is not null").groupBy("h").agg(F.min("id").alias("class_id"))
    return rows.join(least, "h", "left").select("id", "class_id")


def render(vectors: np.ndarray, side: int = 72) -> np.ndarray:
    """Grey test images (image, y, x) drawn from vectors of 64 numbers: a rough texture, whose knots are fixed mixtures of the numbers."""
    v = np.zeros((len(vectors), 64))
    v[:, : vectors.shape[1]] = np.nan_to_num(vectors)[:, :64]
    knots = side // 4 + 1
    field = v @ np.random.default_rng(23).normal(0, 1, (64, knots * knots))
    field /= np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-9)
    at = (np.arange(side) + 0.5) / 4
    spread = np.clip(1 - np.abs(at[:, None] - np.arange(knots)), 0, 1)
    return 128 + 45 * np.clip(spread @ field.reshape(-1, knots, knots) @ spread.T, -2.8, 2.8)


def drawn(vectors: DataFrame, id_col: str, vector_col: str, edit: bool = False) -> DataFrame:
    """(id, data): each vector as a PGM image; with `edit` cropped on all sides, and of other brightness and contrast. A null vector gives null."""
    rows = vectors.select(F.col(id_col), F.col(vector_col).cast("array<double>").alias("v"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                given = b.column(1).to_pylist()
                dense = np.zeros((len(given), 64))
                for i, v in enumerate(given):
                    part = [np.nan if x is None else x for x in (v or [])[:64]]
                    dense[i, : len(part)] = part
                pictures = render(dense)
                if edit:
                    pictures = 0.85 * pictures[:, 5:-7, 6:-4] + 14
                data = [None if v is None else encode(p) for v, p in zip(given, pictures, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], [id_col, "data"])

    return rows.mapInArrow(scan, T.StructType([rows.schema[0], T.StructField("data", T.BinaryType())]))
