import hashlib
import re

from wardline.llm import decontam


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=13):
    out = []
    for doc, text in docs:
        w = words(text)
        hit, named = set(), set()
        for item, t in items:
            v = words(t)
            n = min(window, len(v))
            for i in range(len(v) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[i : i + n]:
                        hit.update(range(j, j + n))
                        if item is not None:
                            named.add(str(item))
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(named), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


LONG = " ".join(f"Tok{i}" for i in range(40))
ITEMS = [(1, LONG), (2, "short item here"), (3, ""), (4, None), (10, "same WINDOW " * 10), (None, "null id item has words " * 4), (5, LONG), (5, LONG), (6, "solo")]
DOCS = [
    (1, LONG), (2, "x " * 300 + LONG[30:200] + " y"), (3, "Short, item--here! and short item; here"), (4, ""), (5, None), (6, "same window " * 30), (7, "null id item has words " * 8),
    (7, "null id item has words " * 8), (8, "é tok1 ünï solo " * 3), (9, "nothing at all"), (None, "short item here"), (10, ("Tok0 " * 13) + LONG), (11, "a " * 50000 + LONG),
]


def run(spark, block_bytes):
    docs = spark.createDataFrame([(i, t, 1) for i, t in DOCS], "doc_id bigint, text string, n_hit int").repartition(2)
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id bigint, text string, doc_id string")
    got = decontam.find_contamination(docs, items, block_bytes=block_bytes)
    return sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()], key=str)


def test_equals_brute_force_in_one_block(spark):
    assert run(spark, 1 << 24) == brute(DOCS, ITEMS)


def test_equals_brute_force_in_many_blocks(spark):
    assert run(spark, 100) == brute(DOCS, ITEMS)


def test_long_items_are_cut_without_losing_windows(spark):
    text = " ".join(f"v{i}" for i in range(9000))
    docs = [(k, " ".join(f"v{i}" for i in range(k, k + 20))) for k in (0, 4090, 4100, 8975)]
    got = decontam.find_contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, text)], "item_id bigint, text string"))
    assert all(r.n_hit == 20 and r.n_items == 1 for r in got.collect())


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert not decontam.find_contamination(docs, none).first().contaminated
    assert decontam.find_contamination(docs.where("false"), spark.createDataFrame(ITEMS, "item_id bigint, text string")).collect() == []


def test_merged_spans():
    assert decontam.merge([5, 9, 0, 3, 8, 12, 3, 4]) == [(0, 4), (5, 12)]


def test_clashing_names_and_bounded_residence(spark):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in DOCS], "doc_id bigint, text string, N_HIT int, c0 int").repartition(2)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    for block in (100, 1 << 24):
        got = decontam.find_contamination(docs, items, keep=("doc_id", "N_HIT", "c0", "text"), block_bytes=block)
        assert got.columns == ["doc_id", "c0", "text", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
        assert sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()], key=str) == brute(DOCS, ITEMS)
        assert all(r.c0 == 2 for r in got.collect())
