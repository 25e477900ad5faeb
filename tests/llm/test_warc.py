import hashlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from wardline.llm import warc
from wardline.llm.queries import op11_warc

SCHEMA = "page_id long, url string, html string"
PARTS = [
    "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:1>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n", "\nWARC/1.", "WARC/1.1\r\n", "\r\n", "\n", "x" * 300, "é" * 40,
    "\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nabc", "\r\n\r\nWARC/1.1\r\nContent-Length: 99999999999999999999\r\n\r\n",
]


def pages(seed, n=200):
    rng = random.Random(seed)
    rows = [(i, f"http://a/{i}\r\nContent-Length: 7", "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))) for i in range(n)]
    return rows + [(1000 + i, None, "same" * 400) for i in range(5)] + [(None, None, None), (None, "u", "same" * 400), (2000, "u", "short"), (2001, "u", "short"), (3000, "u", "big\r\n" * 100_000)]


def expected(rows):
    """(id, bytes, digest, type, refers_to) of every row."""
    best = {}
    for i, _, t in rows:
        if len((t or "").encode()) >= 1000 and i is not None:
            best[t] = max(best.get(t, i), i)
    out = []
    for i, _, t in rows:
        b = (t or "").encode()
        revisit = len(b) >= 1000 and best.get(t) != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", best[t] if revisit else None))
    return sorted(out, key=str)


@pytest.fixture(params=["2000", "100000"])
def splits(spark, request):
    """Small splits put boundaries everywhere: in headers, in payloads and in separators."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("few", [100_000, 0])
def test_round_trip_with_magic_in_payloads(spark, tmp_path, splits, few, monkeypatch):
    monkeypatch.setattr(warc, "FEW", few)
    rows = pages(int(splits) + few)
    spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("__same", F.lit(1)).withColumn("VALUE", F.lit("v")).write.parquet(f"{tmp_path}/pages.parquet")
    got = op11_warc(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_payloads_come_back(spark, tmp_path):
    rows = pages(9, 40)
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    warc.write_archive(spark.createDataFrame(rows, SCHEMA).repartition(2), path)
    got = warc.read_archive(spark, path, payloads=True).where("type = 'response'").collect()
    texts = {hashlib.sha1((t or "").encode()).hexdigest(): (t or "").encode() for _, _, t in rows}
    assert len(got) == sum(e[3] == "response" for e in expected(rows))
    assert all(bytes(r.payload) == texts[r.stated_digest] and r.digest == r.stated_digest for r in got)
    assert {r.uri for r in got} >= {"http://a/1%0D%0AContent-Length: 7", None}


def test_chains_end_at_damage(spark, tmp_path):
    """A foreign file: a record of no HTTP, one whose length is wrong, and what follows it; then a file cut off, and one that is no archive."""
    record = lambda body, n=None: f"WARC/1.0\r\nWARC-Type: resource\r\ncontent-length:  {len(body) if n is None else n}\r\n\r\n{body}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((record("one") + record("two\nWARC/1.0\r\n") + record("three", 4) + record("four")).encode())
    (tmp_path / "b.warc").write_bytes((record("five") + record("six")[:-6]).encode())
    (tmp_path / "c.warc").write_bytes(("x" + record("seven")).encode())
    (tmp_path / "d.warc").write_bytes(b"")
    got = warc.read_archive(spark, str(tmp_path), payloads=True).collect()
    assert sorted((r.file[-6:], bytes(r.payload)) for r in got) == [("a.warc", b"one"), ("a.warc", b"three"[:4]), ("a.warc", b"two\nWARC/1.0\r\n"), ("b.warc", b"five")]


def test_pointer_jumping_equals_a_walk(spark):
    rng = random.Random(4)
    links, want = [], set()
    for f in range(6):
        at, chain = 0, {}
        while at < 4000:
            chain[at] = at + rng.randint(1, 300)
            at = chain[at]
        rogue = {rng.randint(1, 4000): rng.randint(4001, 5000) for _ in range(50)}
        nexts = {**rogue, **chain}
        if f == 5:
            del nexts[0]
        links += [(f"f{f}", a, b) for a, b in nexts.items()]
        at = 0
        while at in nexts:
            want.add((f"f{f}", at))
            at = nexts[at]
    got = warc.reachable(spark.createDataFrame(links, "file string, at long, to long")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_long_chains_keep_the_plan_small(spark):
    """The estimated size of what is reached stays a number of few digits, however many rounds it took."""
    links = spark.range(300).selectExpr("'f' as file", "id * 5 as at", "id * 5 + 5 as to").union(spark.createDataFrame([("f", 7, 20)], "file string, at long, to long"))
    got = warc.reachable(links)
    size = got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert size < 10**30
    assert sorted(r["at"] for r in got.collect()) == [5 * i for i in range(300)]


def test_no_pages(spark, tmp_path):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    warc.write_archive(spark.createDataFrame([], SCHEMA), path)
    assert warc.read_archive(spark, path).count() == 0
