import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from wardline.llm import conversations

SPACE = " \t\n\v\f\r"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        out += [(conv, turn, "user" if lot == 4 else role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    return out


def brute_repair(rows):
    """Counts, and the best of all edit sequences with at most two insertions in a gap, by enumeration."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    turns = {t for t, _, _ in rows if t is not None}
    kinds, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(SPACE)
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    counts = [max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")],
              sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))]
    best = None

    def search(i, cost, audit, out):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        text = "".join(role[:1] or "-" for role, _ in out)
        if not re.fullmatch("s?(ua)*u?", text):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", text):
            best = min(best or (cost, audit, out), (cost, audit, out), key=lambda b: b[:2])
        if not audit.endswith("II"):
            for role in ("user", "assistant"):
                search(i, cost + 3, audit + "I", [*out, (role, "")])
        if i < len(rows):
            extra = 3 if kinds[i] == "truncated" else 0
            search(i + 1, cost + 4, audit + "D", out)
            if kinds[i] not in ("blank", "duplicate"):
                search(i + 1, cost + extra, audit + "K", [*out, rows[i][1:]])
                for role in ("user", "assistant"):
                    search(i + 1, cost + 3 + extra, audit + "R", [*out, (role, rows[i][2])])

    search(0, 0, "", [])
    return (*counts, best[0], best[1], "\n".join(f"{r}:{t}" for r, t in best[2]))


def some_rows(seed, convs=30):
    rng = random.Random(seed)
    rows = []
    for c in [*range(convs), None]:
        for t in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            text = rng.choice(["Yes.", "No!", "And", " \t\n", "", None, "Why? ", "é.\x0b", f"t{t}?", "Yes. "])
            rows.append((c, rng.choice([t, t, t, t + 3, None, 0]), role, text))
    return rows + rows[:3] + rows[:1] * 4


def repaired(spark, rows, **limits):
    frame = spark.createDataFrame(rows, "conv long, turn long, role string, text string").repartition(3)
    summary, long = conversations.repair(frame, **limits)
    lines = {r.ck: [] for r in summary.collect()}
    for r in long.orderBy("ck", "seg", "p").collect():
        lines[r.ck].append(f"{r.role}:{r.text}")
    shas = {r.ck: r.sha for r in conversations.digests(long).collect()}
    out = {}
    for r in summary.collect():
        text = "\n".join(lines[r.ck] if r.repaired is None else [f"{t.role}:{t.text}" for t in r.repaired])
        assert r.repaired is not None or shas.get(r.ck, hashlib.sha256(b"").hexdigest()) == hashlib.sha256(text.encode()).hexdigest()
        out[r.conv] = (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, text)
    return out


def by_conv(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r[1:])
    return out


def test_repairs_equal_all_edit_sequences(spark):
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in some_rows(1)]
    want = {c: brute_repair(r) for c, r in by_conv(rows).items()}
    assert repaired(spark, rows) == want
    assert repaired(spark, rows, max_rows=2) == want  # cut into segments and folded
    assert repaired(spark, rows, max_rows=1, batch_bytes=100) == want


def test_damage(spark):
    rows = some_rows(2) + [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(5)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = conversations.damaged(frame.withColumn("lot", F.lit(1)).withColumn("COPY", F.lit(2))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_damage(rows), key=str)


def test_a_long_conversation_with_a_third_of_one_row(spark):
    """Long: segments of 50 rows; a copy repeated 700 times folds. Held against the conversation repaired whole."""
    rng = random.Random(5)
    rows = [(1, t, ("user", "assistant")[t % 2] if rng.random() < 0.8 else rng.choice(["system", "user", "assistant"]), rng.choice([f"Line {t}.", f"Cut {t}", "Same.", ""])) for t in range(1400)]
    rows += [(1, 300, "user", "Again.")] * 700 + [(1, None, "assistant", "Early."), (2, 1, "user", "Hi."), (2, 2, "assistant", "Ho.")]
    whole = repaired(spark, rows)
    assert whole[2] == (0, 0, 0, 0, 0, 0, "KK", "user:Hi.\nassistant:Ho.")
    assert repaired(spark, rows, max_rows=50) == whole and whole[1][6].count("D") >= 699


def test_no_rows(spark):
    summary, long = conversations.repair(spark.createDataFrame([], "conv string, turn int, role string, text string"))
    assert summary.count() == 0 and long.count() == 0


def test_the_query_equals_brute_force(spark, tmp_path):
    from wardline.llm.queries import op12_conversation_repair

    rows = some_rows(3, 60)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    damaged = by_conv(brute_damage(rows))
    got = {r.conv_id: tuple(r)[1:] for r in op12_conversation_repair(spark, str(tmp_path)).collect()}
    for conv in {r[0] for r in rows}:
        want = brute_repair(damaged[conv]) if conv in damaged else (0, 0, 0, 0, 0, 0, "", "")
        assert got.pop(conv) == (*want[:7], hashlib.sha256(want[7].encode()).hexdigest())
    assert not got
