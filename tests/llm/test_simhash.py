import re

import xxhash

from wardline.llm import simhash
from wardline.llm.common import connected_components

LOW = "".join(chr(c + 32) if 65 <= c <= 90 else chr(c) for c in range(128))


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(LOW[ord(c)] if ord(c) < 128 else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(prints[i] ^ prints[j]).count("1") <= 2:
                    label[i] = label[j] = min(label[i], label[j])
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((doc, prints[i], min(ids, default=None)))
    return sorted(out, key=str)


def docs_of(spark):
    base = " ".join(f"w{i % 97}x{i}" for i in range(900))
    near = [base.replace(f"w{k}x{k} ", "changed ", 1) for k in (5, 6, 7)]
    return [
        (1, base), (2, base.upper()), (9, near[0]), (4, near[1]), (5, near[2]), (6, ""), (7, None), (8, " \t\n\x0b"), (10, "one"), (11, "one two"),
        (12, "one two   three"), (13, "É ÄÖ é"), (14, "a b c " * 50), (15, "a b c " * 80), (None, "one"), (None, "lonely null id"), (16, base), (16, base),
        (17, "Ünï " * 20000),
    ]


def test_fingerprints_and_components_equal_brute_force(spark):
    rows = docs_of(spark)
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id bigint, text string, fp int, root string").repartition(3)
    got = simhash.near_duplicate_groups(docs.select("doc_id", "text")).select("doc_id", simhash.hex_fingerprint().alias("h"), "component_id").collect()
    assert sorted([(r.doc_id, int(r.h, 16), r.component_id) for r in got], key=str) == brute_components(rows)


def test_extra_columns_clash_without_harm(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 3), (2, "a b c", "y", 4)], "doc_id bigint, text string, fp string, component_id int")
    assert [r.component_id for r in simhash.near_duplicate_groups(docs).collect()] == [1, 1]


def test_one_of_each_group_stays(spark):
    rows = docs_of(spark)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, fp string")
    kept = simhash.one_of_each_group(docs).collect()
    classes = {}
    prints = [brute_fingerprint(t) for _, t in rows]
    for i in range(len(rows)):
        classes.setdefault(next(j for j in range(len(rows)) if brute_same(prints, i, j)), i)
    assert len(kept) == len(classes)
    assert {r.doc_id for r in kept} >= {1, 6, 10, 11}


def brute_same(prints, i, j):
    seen, todo = {i}, [i]
    while todo:
        a = todo.pop()
        for b in range(len(prints)):
            if b not in seen and bin(prints[a] ^ prints[b]).count("1") <= 2:
                seen.add(b)
                todo.append(b)
    return j in seen


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicate_groups(docs).collect() == []
    assert simhash.one_of_each_group(docs).collect() == []


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 164)] + [(7, k) for k in range(1000, 1200)] + [(5, 5), (300, 301), (301, 300)]
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.root for r in connected_components(frame).collect()}
    assert all(got[i] == 100 for i in range(100, 165)) and all(got[k] == 7 for k in range(1000, 1200)) and got[301] == 300 and 5 not in got


def test_odd_radius_is_refused(spark):
    import pytest

    with pytest.raises(ValueError):
        simhash.links(spark.range(1).withColumnRenamed("id", "fp"), 3)
