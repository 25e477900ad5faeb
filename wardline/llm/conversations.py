"""Repair of damaged conversations to the grammar (s?(ua)+)? of role initials at the least cost.

Conversations are hash-partitioned into batches of bounded size. In each batch a recursive DuckDB query
advances one turn of all conversations at a time and keeps, for each of the grammar's four states
(0 nothing yet, 1 after system, 2 after user, 3 after assistant), the cheapest edits that end there:
their cost and their audit, a string of initials. Audits of equal cost that end in one state are never
prefixes of each other (an insertion costs), so the least one stays the least whatever follows.

A conversation over the bounds is cut by range into segments. The same recursion runs over them from
each of the four states, and a fold over a conversation's segments, in order, joins their costs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import cut, lookup

#: Rows and bytes of text of a conversation up to which it is repaired whole, and bytes of a batch.
MAX_ROWS, MAX_BYTES, BATCH_BYTES = 4096, 8 << 20, 16 << 20
#: Long conversations up to which their keys are broadcast.
FEW = 100_000

_TURNS = "array<struct<edit: string, role: string, text: string>>"
_MOVES = "array<struct<start: int, stop: int, cost: bigint, audit: string>>"
_STATS = "n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, low bigint, high bigint, turns bigint"
SEGMENT = f"ck string, seg int, whole boolean, {_STATS}, cost bigint, audit string, repaired {_TURNS}, moves {_MOVES}"

_MACROS = r"""
create macro ext(f, cost, letters) as case when f is not null then {'cost': f.cost + cost, 'audit': f.audit || letters} end;
create macro bare(t) as trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13));
"""

# Equal rows fold, with their number; a copy's first fault is that it repeats, and it can only be deleted.
_ROWS = """
create table line as
with key as (select dense_rank() over (order by ck, seg) as k, * from given),
folded as (select k, turn, role, text, sum(n)::bigint as n, bool_or(seen) as seen from key group by all),
placed as (
  select *, row_number() over (partition by k order by turn nulls first, role, md5(text), text) as i, bare(text) = '' as blank,
    seen or row_number() over (partition by k, role, text order by turn nulls first) > 1 as again, left(role, 1) as ini
  from folded)
select *, not blank and not again and right(bare(text), 1) not in ('.', '!', '?') as short, blank or again as dead,
  coalesce(sum(n) over (partition by k order by i rows between unbounded preceding and 1 preceding), 0)::bigint + 1 as place,
  lag(ini) over (partition by k order by i) as before
from placed;
create table owner as select distinct dense_rank() over (order by ck, seg) as k, ck, seg, whole from given;
"""

# In one step the row is kept, given another role or deleted; then turns may be inserted.
_WALK = """
create table walk as
with recursive step as (
  select k, i, ini, dead, case when short then 3 else 0 end as extra, 4 * n as gone, repeat('D', n::bigint) as all_gone, 4 * (n - 1) as rest, repeat('D', n::bigint - 1) as copies from line
), start as (
  select k, s, {'cost': 0::bigint, 'audit': ''} as zero, whole from owner, range(4) t(s) where s = 0 or not whole
), walk using key (k, s) as (
  select k, s, 0::bigint as i, case when s = 0 then zero end as f0, case when s = 1 then zero end as f1,
    case when whole then ext(zero, 3, 'I') when s = 2 then zero end as f2, case when whole then ext(zero, 6, 'II') when s = 3 then zero end as f3
  from start
  union
  select k, s, i, g0, g1, h2, least(g3, ext(h2, 3, 'I')) as f3
  from (
    select *, least(g2, ext(g0, 3, 'I'), ext(g1, 3, 'I'), ext(g3, 3, 'I')) as h2
    from (
      select walk.k, s, step.i, ext(f0, gone, all_gone) as g0,
        least(ext(f1, gone, all_gone), case when ini = 's' and not dead then ext(f0, extra + rest, 'K' || copies) end) as g1,
        least(ext(f2, gone, all_gone), case when not dead then ext(least(f0, f1, f3), extra + rest + case when ini = 'u' then 0 else 3 end, case when ini = 'u' then 'K' else 'R' end || copies) end) as g2,
        least(ext(f3, gone, all_gone), case when not dead then ext(f2, extra + rest + case when ini = 'a' then 0 else 3 end, case when ini = 'a' then 'K' else 'R' end || copies) end) as g3
      from walk join step on step.k = walk.k and step.i = walk.i + 1)))
select * from walk;
"""

# What the edits leave: roles alternate, so a turn's place tells the role that is inserted or given.
_EMIT = """
with letter as (
  select k, s, a[p] as edit, p, sum((a[p] <> 'I')::int) over w as place, sum((a[p] <> 'D')::int) over w as nth
  from (select k, s, audit as a, unnest(range(1, len(audit) + 1)) as p from chosen) window w as (partition by k order by p)
), joined as (
  select l.k, l.p, l.edit, l.s, l.nth, r.role, r.text, max((l.nth = 1 and l.s = 0 and l.edit = 'K' and r.ini = 's')::int) over (partition by l.k) as system
  from letter l left join line r on l.edit <> 'I' and r.k = l.k and r.place = l.place where l.edit <> 'D'
)
select k, p, edit, case when edit = 'K' then role when (nth - system + (s = 2)::int) % 2 = 1 then 'user' else 'assistant' end as role,
  case when edit = 'I' then '' else text end as text
from joined
"""

_SEGMENTS = f"""
with chosen_turns as (
  select k, list({{'edit': edit, 'role': role, 'text': text}} order by p) as repaired from ({_EMIT}) group by k
), stats as (
  select k, sum(n)::bigint as n, sum(case when blank then n else 0 end)::bigint as blank, sum(case when blank then 0 when again then n else n - 1 end)::bigint as duplicate,
    sum(short::int)::bigint as truncated, sum(n - 1 + (before is not null and before || ini not in ('su', 'ua', 'au'))::int)::bigint as illegal,
    arg_min(ini, i) as first, arg_max(ini, i) as last, min(turn) as low, max(turn) as high, count(distinct turn) as turns
  from line group by k
), moves as (
  select k, list({{'start': s::int, 'stop': stop, 'cost': f.cost, 'audit': f.audit}}) as moves
  from (select k, s, unnest([0, 1, 2, 3])::int as stop, unnest([f0, f1, f2, f3]) as f from walk) where f is not null group by k
)
select ck, seg, whole, stats.* exclude (k), chosen.cost, chosen.audit, coalesce(repaired, []) as repaired, case when not whole then moves end as moves
from owner join stats using (k) join moves using (k) left join chosen using (k) left join chosen_turns using (k)
"""


def _connection(given: pa.Table) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 1, "temp_directory": "", "memory_limit": "1GB"})
    con.execute(_MACROS)
    con.register("given", given)
    con.execute(_ROWS)
    return con


def _arrow(con: duckdb.DuckDBPyConnection, sql: str, names: list[str]) -> pa.Table:
    found = con.sql(sql).to_arrow_table()
    con.close()
    return found.select(names)


def _segments(given: pa.Table) -> pa.Table:
    """All conversations, or segments, of a batch: counts, and the best edits, or the best between any two states."""
    con = _connection(given)
    con.execute(_WALK)
    con.execute("create table chosen as select k, 0 as s, least(f0, f3).cost as cost, least(f0, f3).audit as audit from walk join owner using (k) where whole")
    return _arrow(con, _SEGMENTS, SEGMENT_ARROW.names).cast(SEGMENT_ARROW)


SEGMENT_ARROW = pa.schema([
    ("ck", pa.string()), ("seg", pa.int32()), ("whole", pa.bool_()), ("n", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
    ("repaired", pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))),
    ("moves", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
])


def _emit(given: pa.Table, parts: pa.Table) -> pa.Table:
    """The repaired turns of a batch of segments, whose edits `parts` (ck, seg, s, audit) names."""
    con = _connection(given)
    con.register("part", parts)
    con.execute("create table chosen as select k, s, audit from owner join part using (ck, seg)")
    names = ["ck", "seg", "p", "edit", "role", "text"]
    schema = pa.schema([("ck", pa.string()), ("seg", pa.int32()), ("p", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    return _arrow(con, f"select ck, seg, e.* exclude (k) from ({_EMIT}) e join owner using (k)", names).cast(schema)


#: Cost and audit to be in a state before the first row.
FIRST = {0: (0, ""), 2: (3, "I"), 3: (6, "II")}


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Joins sorted segments: one row a segment with its edits, and the conversation's figures on its last."""
    columns = ["ck", "seg", "s", "audit", "is_last", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns", "cost", "whole_audit"]

    def finished(now: dict) -> pd.DataFrame:
        stop = min((s for s in (0, 3) if s in now["best"]), key=lambda s: now["best"][s])
        cost, audit = now["best"][stop]
        rows = []
        for seg, came in reversed(now["path"]):
            start, part = came[stop]
            rows.append([now["ck"], seg, start, part, False, *[None] * 9])
            stop = start
        rows[-1][2:4] = [0, FIRST[stop][1] + rows[-1][3]]  # what is inserted before the first row belongs to the first segment
        rows[0][4:] = [True, *[now[c] for c in ("blank", "duplicate", "truncated", "illegal", "low", "high", "turns")], cost, audit]
        return pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in columns[5:13]})

    now = None
    for batch in batches:
        for r in batch.itertuples(index=False):
            if now is not None and now["ck"] != r.ck:
                yield finished(now)
                now = None
            if now is None:
                now = {"ck": r.ck, "best": FIRST, "path": [], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "last": None, "low": None, "high": None, "turns": 0}
            best, came = {}, {}
            for m in r.moves:
                if m["start"] in now["best"]:
                    cost, audit = now["best"][m["start"]]
                    way = (cost + m["cost"], audit + m["audit"])
                    if m["stop"] not in best or way < best[m["stop"]]:
                        best[m["stop"]], came[m["stop"]] = way, (m["start"], m["audit"])
            now["best"] = best
            now["path"].append((r.seg, came))
            for c in ("blank", "duplicate", "truncated", "illegal"):
                now[c] += int(getattr(r, c))
            now["illegal"] += now["last"] is not None and now["last"] + r.first not in ("su", "ua", "au")
            now["last"] = r.last
            if not pd.isna(r.low):
                now["turns"] += int(r.turns) - (now["high"] is not None and now["high"] == int(r.low))
                now["low"], now["high"] = int(r.low) if now["low"] is None else now["low"], int(r.high)
    if now is not None:
        yield finished(now)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the lines of conversations that come one after the other, in order; holds one state at a time."""
    now, state = None, None
    for batch in batches:
        for ck, role, text in batch[["ck", "role", "text"]].itertuples(index=False):
            if ck != now:
                if now is not None:
                    yield pd.DataFrame({"ck": [now], "sha": [state.hexdigest()]})
                now, state, mark = ck, hashlib.sha256(), b""
            state.update(mark + f"{role}:{text}".encode())
            mark = b"\n"
    if now is not None:
        yield pd.DataFrame({"ck": [now], "sha": [state.hexdigest()]})


def key_of(conv: str):
    """A conversation's id as text that is never null."""
    return F.coalesce(F.concat(F.lit("v"), F.col(conv).cast("string")), F.lit(""))


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) after damage by crc32 of "conv:turn" modulo 20; null ids, turns, roles and texts are one space there.

    0 drops the row, 1 empties its text, 2 removes [.!?] from it, 3 repeats the row and 4 makes its role user.
    """
    text_of = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    lot = F.crc32(F.concat_ws(":", text_of(conv_col), text_of(turn_col)).cast("binary")) % 20
    out = rows.select(rows[conv_col].alias("conv"), rows[turn_col].cast("bigint").alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text"), lot.alias("lot")).where("lot <> 0")
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    out = out.select("conv", "turn", F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.expr("explode(array_repeat(0, if(lot = 3, 2, 1)))").alias("copy"))
    return out.drop("copy")


def repair(rows: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, batch_bytes: int = BATCH_BYTES) -> tuple[DataFrame, DataFrame]:
    """Repairs the conversations in `rows` (conv, turn, role, text): (summary, long), of one row a conversation and one row a turn.

    Rows stand in order of turn, nulls first; of one turn in order of role and the MD5 of the text. A row's
    first fault counts: blank (nothing but white space), duplicate (role and text seen earlier in the
    conversation), truncated (does not end in [.!?]). Keep is free, another role costs 3, deleting 4 and
    inserting an empty turn 3; blank and duplicate rows have to be deleted, a truncated one costs 3 more if
    it stays. The cheapest edits win, of equal ones those with the least audit (D before I, K, R).

    summary: ck, conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired. `repaired` has the
    turns (edit, role, text) of a conversation of up to `max_rows` rows and `max_bytes` bytes; those
    of a longer one, whose `repaired` is null, are the rows of `long`: ck, seg, p, edit, role, text, in
    this order. Null conversations are one conversation; nulls in roles and texts are one space; an
    empty table gives empty results.
    """
    kind = rows.schema["conv"].dataType
    rows = rows.select(key_of("conv").alias("ck"), "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    stats = cut(rows.groupBy("ck").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + F.octet_length("role") + 16).alias("bytes")))
    is_long = (F.col("n") > max_rows) | (F.col("bytes") > max_bytes)
    facts = stats.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count(F.when(is_long, 1)).alias("long"), F.coalesce(F.sum(F.when(is_long, F.greatest(F.col("n") / max_rows, F.col("bytes") / max_bytes))), F.lit(0.0)).alias("parts")).first()
    batches = max(1, -(-facts.bytes // batch_bytes))
    few = F.broadcast if facts.long <= FEW else lambda x: x
    longs = few(stats.where(is_long).select("ck"))
    short = (rows.join(longs, "ck", "left_anti") if facts.long else rows).select(
        "ck", F.lit(0).alias("seg"), F.lit(True).alias("whole"), "turn", "role", "text", F.lit(1).cast("bigint").alias("n"), F.lit(False).alias("seen"), F.pmod(F.xxhash64("ck"), F.lit(batches)).alias("batch"))
    done = short.groupBy("batch").applyInArrow(_segments, SEGMENT)
    figures = ["blank", "duplicate", "truncated", "illegal", "low", "high", "turns", "cost", "audit"]
    summary = done.select("ck", *figures, "repaired")
    turns = rows.sparkSession.createDataFrame([], "ck string, seg int, p long, edit string, role string, text string")
    if facts.long:
        segments = cut(_cut_up(rows.join(longs, "ck", "left_semi"), max(2, 2 * int(facts.parts + 1))))
        moves = segments.groupBy("seg").applyInArrow(_segments, SEGMENT).select("ck", "seg", *figures[:7], "first", "last", "moves")
        folded = "ck string, seg int, s int, audit string, is_last boolean, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, cost long, whole_audit string"
        parts = cut(moves.repartition("ck").sortWithinPartitions("ck", "seg").mapInPandas(_folded, folded))
        ends = parts.where("is_last").withColumn("audit", F.col("whole_audit"))
        summary = summary.unionByName(ends.select("ck", *figures, F.lit(None).cast(_TURNS).alias("repaired")))
        turns = segments.groupBy("seg").cogroup(parts.select("ck", "seg", "s", "audit").groupBy("seg")).applyInArrow(_emit, turns.schema)
    gaps = F.coalesce(F.try_add(F.try_subtract("high", "low"), 1 - F.col("turns")), F.when(F.col("low").isNull(), 0).otherwise(F.lit((1 << 63) - 1)))
    conv = F.when(F.col("ck") != "", F.expr("substring(ck, 2)")).cast(kind)  # a key is its conversation's id as text, so no join brings it back
    return summary.select("ck", conv.alias("conv"), gaps.cast("bigint").alias("gaps"), *figures[:4], "cost", "audit", "repaired"), turns


def _cut_up(rows: DataFrame, parts: int) -> DataFrame:
    """Segments of long conversations: equal rows fold, what an earlier turn has is `seen`, and ranges of (conversation, turn, role, text) become `seg`.

    The checkpoint of what this gives fixes the numbers of the ranges.
    """
    folded = rows.groupBy("ck", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("digest", F.md5(F.col("text").cast("binary")))
    folded = cut(folded.withColumn("same", F.sha2(F.to_json(F.struct("ck", "role", "text")), 256)).withColumn("when", F.struct(F.col("turn").isNotNull().alias("known"), "turn")))
    firsts = cut(folded.groupBy("same").agg(F.min("when").alias("first_when")))
    marked = lookup(folded, firsts, "same").withColumn("seen", F.col("when") > F.col("first_when"))
    ranged = marked.repartitionByRange(parts, F.col("ck"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"))
    return ranged.select("ck", F.spark_partition_id().alias("seg"), F.lit(False).alias("whole"), "turn", "role", "text", "n", "seen")


def digests(long: DataFrame) -> DataFrame:
    """(ck, sha) of the turns of long conversations, each read once in order."""
    return long.repartition("ck").sortWithinPartitions("ck", "seg", "p").select("ck", "role", "text").mapInPandas(_digests, "ck string, sha string")
