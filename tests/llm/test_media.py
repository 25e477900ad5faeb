import numpy as np
import pytest

from wardline.llm import media
from wardline.llm.common import table


def test_decoding():
    grey = np.arange(12, dtype=np.float32).reshape(3, 4)
    assert (media.decode(media.encode(grey)) == grey).all()
    assert (media.decode(b"P5\n# note\n4 3\n255\n" + bytes(range(12))) == grey).all()
    rgb = media.decode(b"P6 1 1 255\n" + bytes([255, 255, 255]))
    assert rgb.shape == (1, 1) and abs(rgb[0, 0] - 255) < 0.1
    for bad in (None, b"", b"JPEG", b"P5 4 3 255\nshort", b"P5 x", b"P5 0 3 255\n", b"P5 2 2 999\nabcd", b"P5 #"):
        assert media.decode(bad) is None


def pictures(n, seed=1):
    return media.render(np.random.default_rng(seed).normal(0, 0.1, (n, 64)))


def test_crops_brightness_and_quarter_turns_are_found(spark):
    base = pictures(40)
    images = [(i, media.encode(p)) for i, p in enumerate(base)] + [(100, media.encode(base[3])), (101, None), (102, b"junk"), (3, media.encode(base[3]))]
    asked = [(1000 + i, media.encode(0.8 * base[i][5:-8, 7:-3] + 20)) for i in range(0, 40, 2)] + [(2000 + i, media.encode(np.rot90(base[i]))) for i in range(8)] + [(5000, media.encode(pictures(1, 9)[0])), (5001, None)]
    frame = spark.createDataFrame(images, "id int, data binary").repartition(3)
    queries = spark.createDataFrame(asked, "id int, data binary")
    got = {}
    for r in media.find_copies(queries, frame, "id", "data").collect():
        got.setdefault(r.query_id, set()).add(r.class_id)
    found = sum(i in got.get(1000 + i, ()) for i in range(0, 40, 2))
    turned = sum(i in got.get(2000 + i, ()) for i in range(8))
    wrong = sum(len(v - {k - 1000, k - 2000}) for k, v in got.items())
    assert found == 20 and turned == 8 and wrong <= 4 and 5001 not in got
    classes = {(r.id, r.class_id) for r in media.classes(frame, "id", "data").collect()}
    assert {(100, 3), (3, 3), (101, None), (102, 102)} <= classes


def test_recall_on_the_table(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    images, edited = media.drawn(vectors, "vec_id", "embedding"), media.drawn(vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", edit=True)
    found = {(r.query_id, r.class_id) for r in media.find_copies(edited, images, "vec_id", "data").collect()}
    asked = [r.vec_id for r in vectors.where("vec_id % 20 = 0").collect()]
    assert np.mean([(i, i) in found for i in asked]) >= 0.9


@pytest.mark.parametrize("shape", [(1, 1), (26, 26), (5, 200)])
def test_small_and_flat_images(shape):
    n, *_, bits = media.describe(np.full((2, *shape), 7.0, np.float32))
    assert len(n) == 0 and bits.shape == (0, 32)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id int, data binary")
    some = spark.createDataFrame([(1, media.encode(pictures(1)[0]))], "id int, data binary")
    assert media.find_copies(none, some, "id", "data").collect() == []
    assert media.find_copies(some, none, "id", "data").collect() == []
    nulls = spark.createDataFrame([(1, None), (2, [0.1, None])], "id int, v array<float>")
    assert [r.data is None for r in media.drawn(nulls, "id", "v").orderBy("id").collect()] == [True, False]


def test_search_equals_brute_force_to_24_bits():
    """Any 24 differing bits are found, also where every 32-bit and 64-bit part differs; and nothing at 25."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, (300, 32), np.uint8)
    near = base.copy()
    for row, n in zip(near, [0, 1, 7, 23, 24, 25] * 50, strict=True):
        for bit in rng.permutation(256)[:n]:
            row[bit // 8] ^= 1 << (bit % 8)
    a, b = base.view(np.uint64), near[[*range(300), 0, 0]].view(np.uint64)
    corner = lambda bits: np.array([(0, 0, 1, 0, x) for x in bits], media.CORNER)
    i, j = media.Exact(corner(b), np.zeros(302, int), 24).pairs(corner(a), np.zeros(300, int))
    expected = np.argwhere(np.bitwise_count(a[:, None] ^ b[None]).sum(2, dtype=int) <= 24)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [tuple(e) for e in expected.tolist()]


def test_blocks_do_not_change_what_is_found(spark):
    base = pictures(12)
    frame = spark.createDataFrame([(i, media.encode(p)) for i, p in enumerate(base)], "id int, data binary")
    asked = spark.createDataFrame([(100 + i, media.encode(0.8 * p[5:-8, 7:-3] + 20)) for i, p in enumerate(base[:6])], "id int, data binary")
    whole, parts = (sorted(map(tuple, media.find_copies(asked, frame, "id", "data", block=n).collect())) for n in (1 << 18, 30))
    assert whole == parts and len(whole) >= 5


def turned(p, degrees):
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    y, x = np.mgrid[0:72, 0:72] - 35.5
    yy, xx = np.clip(35.5 - s * x + c * y, 0, 70.99), np.clip(35.5 + c * x + s * y, 0, 70.99)
    i, j = yy.astype(int), xx.astype(int)
    v, u = yy - i, xx - j
    return p[i, j] * (1 - v) * (1 - u) + p[i, j + 1] * (1 - v) * u + p[i + 1, j] * v * (1 - u) + p[i + 1, j + 1] * v * u


NOISE = np.random.default_rng(2)
EDITS = {
    "cropped": lambda p: p[5:-7, 6:-4], "cropped to half": lambda p: p[12:-8, 9:-12], "dimmed": lambda p: 0.7 * p + 10, "brightened": lambda p: 1.25 * p + 10,
    "scaled to 0.75": lambda p: media._resized(p, 0.75), "scaled to 0.85": lambda p: media._resized(p, 0.85), "scaled to 1.3": lambda p: media._resized(p, 1.3),
    "turned by 4": lambda p: turned(p, 4), "turned by 15": lambda p: turned(p, 15), "turned by 90": np.rot90, "noised": lambda p: p + NOISE.normal(0, 4, p.shape),
}


def packed(pictures, scales):
    """Corners of pictures, and whose they are."""
    out, owner = [], []
    for i, p in enumerate(pictures):
        f = media.describe(np.clip(np.rint(p), 0, 255)[None].astype(np.float32), scales)
        rows = np.zeros(len(f[0]), media.CORNER)
        rows["x"], rows["y"], rows["scale"], rows["angle"] = f[1:5]
        rows["bits"] = np.ascontiguousarray(f[5]).view(np.uint64)
        out.append(rows)
        owner += [i] * len(rows)
    return np.concatenate(out), np.array(owner)


def voted(mine, image, theirs, query, i, j, votes):
    """Plain votes: every match for the two nearest bins of rotation and shift; corners of the query count once a bin."""
    bins = {}
    for m, q in zip(i.tolist(), j.tolist(), strict=True):
        a, b = mine[m], theirs[q]
        turn, ratio = float(a["angle"]) - float(b["angle"]), float(b["scale"]) / float(a["scale"])
        sx = float(a["x"]) - ratio * (np.cos(turn) * float(b["x"]) - np.sin(turn) * float(b["y"]))
        sy = float(a["y"]) - ratio * (np.sin(turn) * float(b["x"]) + np.cos(turn) * float(b["y"]))
        low = [int(np.floor(v / step - 0.5)) for v, step in ((turn, 0.5), (sx, 8), (sy, 8))]
        for k in range(8):
            key = (image[m], query[q], int(np.rint(4 * np.log2(ratio))), (low[0] + (k & 1)) % 13, low[1] + (k >> 1 & 1), low[2] + (k >> 2))
            bins.setdefault(key, set()).add(q)
    best = {}
    for (m, q, *_), who in bins.items():
        best[m, q] = max(best.get((m, q), 0), len(who))
    return {k: n for k, n in best.items() if n >= votes}


def test_recall_of_every_edit_against_all_pairs():
    """At least 0.9 of the copies are found for each kind of edit, and 0.9 of what comparing all pairs of corners finds."""
    base = list(pictures(60, 5).astype(np.float32))
    mine, image = packed(base, media.SCALES)
    for name, edit in EDITS.items():
        theirs, query = packed([edit(p) for p in base], media.QUERY_SCALES)
        distances = np.bitwise_count(mine["bits"][:, None] ^ theirs["bits"][None]).sum(2, dtype=np.int16)
        every = set(zip(*media.consensus(image, mine, query, theirs, *np.nonzero(distances <= 24), 5)[:2], strict=True))
        found = set(zip(*media.consensus(image, mine, query, theirs, *media.Tables(theirs, query, 24).pairs(mine, image), 5)[:2], strict=True))
        assert found <= every
        assert sum(a == b for a, b in found) / 60 >= 0.9, name
        assert len(found) / len(every) >= 0.9, name


def test_copies_equal_brute_force(spark):
    """With `exact` the same images and votes as comparing every corner with every corner and voting one by one; by default a part of them."""
    base = list(pictures(10, 8).astype(np.float32))
    asked = [edit(base[i]) for i, edit in enumerate(list(EDITS.values())[:10])]
    rounded = lambda ps: [media.decode(media.encode(p)) for p in ps]
    mine, image = packed(rounded(base), media.SCALES)
    theirs, query = packed(rounded(asked), media.QUERY_SCALES)
    distances = np.bitwise_count(mine["bits"][:, None] ^ theirs["bits"][None]).sum(2, dtype=np.int16)
    expected = voted(mine, image, theirs, query, *np.nonzero(distances <= 24), 5)
    frame = spark.createDataFrame([(i, media.encode(p), "x") for i, p in enumerate(base)], "id int, data binary, query_id string").repartition(3)
    queries = spark.createDataFrame([(i, media.encode(p)) for i, p in enumerate(asked)], "id int, data binary")
    run = lambda **how: {(r.class_id, r.query_id): r.votes for r in media.find_copies(queries, frame, "id", "data", **how).collect()}
    assert run(exact=True) == expected and all((i, i) in expected for i in range(10))
    some = run()
    assert all(some[k] == expected[k] for k in some) and len(some) >= 0.9 * len(expected)
