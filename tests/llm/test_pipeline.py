import duckdb
import pytest

import corpus_pipeline
from wardline.llm import langid, queries, simhash
from wardline.llm.common import table


def plain_clean(rows, items):
    """Ids of the documents that the contamination rule leaves, by comparing every place of a text with every window."""
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for w in map(words, items):
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(n, set()).add(tuple(w[i : i + n]))
    clean = set()
    for r in rows:
        w, hit = words(r.text), set()
        for n, known in windows.items():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in known:
                    hit.update(range(i, i + n))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.add(r.doc_id)
    return clean


def test_stages_on_the_table(spark, sf, tmp_path):
    """Every stage against what its operator says of the stage's own input."""
    docs = table(spark, sf, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / name)
        stage(spark, docs, sf).write.parquet(out)
        after = spark.read.parquet(out)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
        before_ids = {r.doc_id for r in docs.select("doc_id").collect()}
        after_ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert after_ids <= before_ids
        if name == "language_id":
            lettered = {r.doc_id for r in docs.collect() if langid.has_letter((r.text or "").encode())}
            assert after_ids == lettered
        elif name == "near_dedup":
            groups = simhash.near_duplicate_groups(docs).collect()
            assert after_ids == {r.component_id for r in groups}
        elif name == "decontaminate":
            clean = plain_clean(docs.select("doc_id", "text").collect(), [r.text for r in table(spark, sf, "benchmark").collect()])
            assert after_ids == clean and len(clean) < len(before_ids)
        elif name == "redact_secrets":
            assert after_ids == before_ids and not after.where("text rlike '[0-9a-f]{24,}|AKIA[A-Z0-9]{16,}'").count()
            assert not after.where("length(text) <> n_chars").count()
        elif name == "mix":
            assert after_ids == before_ids and {"text", "size", "taken", "target"} <= set(after.columns)
        docs = after
    assert docs.count() > 0


def plain_fingerprint(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_dedup(rows):
    """Ids that stay: the least of each group of fingerprints that link at two bits or fewer, by comparing all pairs."""
    prints = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(i) for i in ids}


def plain_redacted(text, model):
    """Known forms, and candidate tokens over the ratio that overlap none, replaced from the left."""
    import re

    text = text or ""
    base = [(m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    base += [(m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [(m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    spans = list(base)
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        known = [(ord(a) - 43) * 80 + ord(b) - 43 for a, b in zip(m[0], m[0][1:])]
        if sum(model[k] for k in known) > 1500 * (len(m[0]) - 1) and all(z <= m.start() or a >= m.end() for a, z in base):
            spans.append((m.start(), m.end()))
    out, at = "", 0
    for a, z in sorted(spans):
        if z > at:
            out += text[at:a] + "[SECRET]" if a >= at else "[SECRET]"
            at = z
    return out + text[at:]


def plain_mix(rows):
    """(id): size, source's size, target, words taken, by one line of documents a source."""
    import hashlib
    import re

    from test_mixing import brute_targets

    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, _, t in rows}
    whole = {}
    for i, s, _ in rows:
        whole[s] = whole.get(s, 0) + size[i]
    targets, out = brute_targets(whole), {}
    for s in whole:
        line, at, due = sorted((hashlib.md5(f"{i}:{size[i]}:mix".encode()).hexdigest(), i) for i, x, _ in rows if x == s), 0, int(targets[s] + 0.5)
        for _, i in line:
            taken = sum(max(0, min(due, at + k * whole[s] + size[i]) - (at + k * whole[s])) for k in range(2))
            out[i] = (size[i], whole[s], targets[s], taken)
            at += size[i]
    return out


def test_the_whole_pipeline_equals_plain_python(spark, sf, tmp_path):
    """Every row and column of run() but the trained labels, from the documents on, in plain Python. Every seventh document has secrets added."""
    import math

    from pyspark.sql import functions as F

    secret = F.concat("text", F.lit(" api_key = 'abcdef123456' é"), F.lit(" Zk2PxV9bLw4TnR8sYcq7Q1wE5rT/9uJ and "), F.sha1(F.col("doc_id").cast("string").cast("binary")), F.lit(" end"))
    table(spark, sf, "documents").withColumn("text", F.when(F.col("doc_id") % 7 == 0, secret).otherwise(F.col("text"))).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, sf, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf = str(tmp_path)
    docs = table(spark, sf, "documents")
    rows = [r for r in docs.collect() if langid.has_letter((r.text or "").encode())]
    first = plain_dedup(rows)
    rows = [r for r in rows if r.doc_id in first]
    clean = plain_clean(rows, [r.text for r in table(spark, sf, "benchmark").collect()])
    rows = [r for r in rows if r.doc_id in clean]
    model = queries.secret_model(docs.where(docs.doc_id.isin([r.doc_id for r in rows])))
    texts = {r.doc_id: plain_redacted(r.text, model) for r in rows}
    want = plain_mix([(r.doc_id, r.source, texts[r.doc_id]) for r in rows])
    got = corpus_pipeline.run(spark, sf).collect()
    assert len(got) == len(rows) and any("[SECRET]" in t for t in texts.values())
    source = {r.doc_id: (r.source, r.lang) for r in rows}
    for r in got:
        assert r.text == texts[r.doc_id] and r.n_chars == len(r.text) and r.source == source[r.doc_id][0]
        size, whole, target, taken = want[r.doc_id]
        assert (r["size"], r.source_size, r.taken) == (size, whole, taken) and math.isclose(r.target, target, rel_tol=1e-9) and (r.slot is None) == (taken == 0)
    assert sum(r.lang == source[r.doc_id][1] for r in got) >= 0.95 * len(got)


def test_stages_with_nulls_repeats_and_no_rows(spark, sf, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "same words in here " * 5, "en", None, 95), (3, "same words in here " * 5, "en", None, 95), (None, "other text entirely", "en", "b", 1), (5, "token = abcdefgh", None, "b", 1)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for start in (frame, frame.where("false")):
        docs, path = start, tmp_path / str(start.count())
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf).write.parquet(str(path / name))
            docs = spark.read.parquet(str(path / name))
        assert docs.count() == (3 if start is frame else 0)


def test_names_and_sql(spark, sf):
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    key = lambda row: str([f"{v:.9g}" if isinstance(v, float) else v for v in row])
    a = sorted(key([r[c] for c in order]) for r in got.collect())
    b = sorted(key([dict(zip(want.columns, r))[c] for c in order]) for r in want.fetchall())
    assert a == b


def test_the_language_query_holds_out_its_quarter(spark, sf):
    import zlib

    for r in queries.op3_language_id(spark, sf).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
