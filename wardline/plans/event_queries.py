"""Queries over events: windows, sessions, streams, as-of and range joins, incremental ingest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.plans.registry import registry
from wardline.sources.sinks import shared_folder
from wardline.sources.views import Views
from wardline.streaming import ingest as I
from wardline.streaming import state

QUERIES, SQL, query = registry()


def _events(spark, sf_dir):
    return Views(spark, sf_dir).events.withColumn("ts", F.col("ts").cast("timestamp"))


_STAMP = "yyyy-MM-dd HH:mm:ss"


@query("select strftime(time_bucket(interval '1 day', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_tumbling(spark, sf_dir):
    return I.windowed(_events(spark, sf_dir), "1 day").select(F.date_format("start", _STAMP).alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""select strftime(s, '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from (
  select *, unnest([time_bucket(interval '12 hours', ts, timestamp '1970-01-01'), time_bucket(interval '12 hours', ts, timestamp '1970-01-01') - interval '12 hours']) as s from events) group by 1, 2""")
def event_sliding(spark, sf_dir):
    return I.windowed(_events(spark, sf_dir), "1 day", "12 hours").select(F.date_format("start", _STAMP).alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""with m as (select *, case when ts - lag(ts) over w < interval '6 hours' then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
g as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from m)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, strftime(max(ts) + interval '6 hours', '%Y-%m-%d %H:%M:%S') as "end", count(*) as n from g group by user_id, k""")
def event_session(spark, sf_dir):
    return I.sessions(_events(spark, sf_dir), "6 hours").select("user_id", F.date_format("start", _STAMP).alias("start"), F.date_format("end", _STAMP).alias("end"), "n")


@query("select event_type, count(*) as n from events group by 1")
def event_stream_counts(spark, sf_dir):
    name = f"counts_{uuid.uuid4().hex}"
    schema = Views(spark, sf_dir).events.schema
    out = I.streamed_counts(spark, sf_dir, "events.parquet", schema, name, f"{shared_folder(spark)}/{name}")
    return out.select("event_type", F.col("count").alias("n"))


@query("select k, count(*) as n, round(avg(value), 6) as mean from (select cast(json_extract(props, '$.k') as bigint) as k, value from events) group by 1")
def event_props(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    return _events(spark, sf_dir).groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""with v as (select event_id, user_id, ts, event_type, value from events), l as (select * from v where event_type = (select min(event_type) from v)), r as (select * from v where event_type <> (select min(event_type) from v))
select l.event_id, x.event_id as last_event from l left join lateral (select r.event_id from r where r.user_id = l.user_id and r.ts <= l.ts order by r.ts desc, r.event_id desc limit 1) x on true""")
def asof_join(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type")
    first = e.agg(F.min("event_type")).first()[0]
    right = e.where(F.col("event_type") != first).groupBy("user_id", "ts").agg(F.max("event_id").alias("last_event"))
    return I.asof(e.where(F.col("event_type") == first), right, "user_id", "ts", "last_event").select("event_id", "last_event")


@query("""with b as (select n_nationkey as band, n_nationkey * 400.0 - 1000 as lo, n_nationkey * 400.0 - 1000 + 700 as hi from nation)
select band, count(*) as n, round(sum(c_acctbal), 2) as total from customer join b on c_acctbal >= lo and c_acctbal < hi group by 1""")
def range_join(spark, sf_dir):
    v = Views(spark, sf_dir)
    bands = v.nation.select(F.col("n_nationkey").alias("band"), (F.col("n_nationkey") * 400.0 - 1000).alias("lo"), (F.col("n_nationkey") * 400.0 - 300).alias("hi"))
    return I.in_ranges(v.customer, bands, "c_acctbal", "lo", "hi", 700.0).groupBy("band").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("select event_type, user_id, value, r from (select event_type, user_id, value, row_number() over (partition by event_type order by value desc, event_id) as r from events) where r <= 3")
def window_rank(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return _events(spark, sf_dir).withColumn("r", F.row_number().over(w).cast("bigint")).where("r <= 3").select("event_type", "user_id", "value", "r")


_HASH = "md5(trim(regexp_replace(lower({t}), '\\s+', ' ', 'g')))"


@query(f"""with d as (select doc_id, coalesce(text, '') as t from documents), v as (select doc_id, {_HASH.format(t='t')} as a, case when doc_id % 10 = 0 then {_HASH.format(t="t || ' changed'")} else {_HASH.format(t='t')} end as b from d)
select count(*) as documents, count_if(a <> b) as changed, count_if(a <> b) as back from v""")
def changed_documents(spark, sf_dir):
    """A second delivery changes every tenth document, a third brings the first contents back: what either adds to the stream's state."""
    from wardline.functions import text as X

    docs = Views(spark, sf_dir).documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    changed = F.when(F.col("doc_id") % 10 == 0, X.content_hash(F.concat("text", F.lit(" changed"))))
    place = f"{shared_folder(spark)}/deliveries-{uuid.uuid4().hex}"
    docs.select("doc_id", X.content_hash(F.col("text")).alias("a"), changed.alias("b")).write.parquet(f"{place}/hashes")  # texts are read once
    hashes = spark.read.parquet(f"{place}/hashes")
    with state.keyed_store(spark):
        for n, digest in enumerate([F.col("a"), F.coalesce("b", "a"), F.col("a")]):
            hashes.select("doc_id", digest.alias("hash"), F.timestamp_seconds(F.lit(86400 * n)).alias("at")).write.parquet(f"{place}/in/{n}")
            stream = spark.readStream.schema("doc_id bigint, hash string, at timestamp").option("recursiveFileLookup", True).parquet(f"{place}/in")
            state.track(stream).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.parquet(f"{place}/out")
    when = lambda n: F.col("at") == F.timestamp_seconds(F.lit(86400 * n))
    return changes.agg(F.count_if(when(0)).alias("documents"), F.count_if(when(1)).alias("changed"), F.count_if(when(2)).alias("back"))
