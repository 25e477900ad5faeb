"""Queries of the corpus operators over the documents, pages and embeddings tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import conversations, decontam, filter_audit, langid, licenses, media, mixing, pii, quality, secrets, simhash, urls, warc
from wardline.llm.common import crc_bucket, cut, shared_folder, table
from wardline.llm.sql import SQL

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_bucket("doc_id", 4) == 2
    net = langid.fit(docs, ~F.coalesce(held_out, F.lit(False)))
    named = langid.identify_language(docs, net, keep=("doc_id",))
    return named.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("language.label").alias("lang_pred"), F.col("language.score").alias("score"))


def secret_model(docs: DataFrame) -> list[int]:
    """Fitted on generated random strings, and on words of a bounded sample of the documents and identifiers made of them; a third of each is held out for the threshold."""
    words = cut(secrets.ordinary_words(docs, "text", "doc_id"))
    kept = F.pmod(F.xxhash64("value", F.lit(3)), F.lit(3)) != 0
    ordinary = words.unionByName(secrets.identifiers(words))
    model = secrets.fit(ordinary.where(kept).unionByName(secrets.random_strings(docs.sparkSession)))
    return secrets.calibrated(model, ordinary.where(~kept).unionByName(secrets.random_strings(docs.sparkSession, 600, 1_000_000)))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, secret_model(docs)).select("doc_id", "secret_spans")
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["kind"] < 3)

    def n(k: int):
        return F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("bigint")

    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(spans).alias("spans"),
    )


def op5_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no images, so each embedding is drawn as one; every 20th, cropped and edited, is searched among all."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    edited = media.drawn(vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", edit=True)
    members = cut(media.classes(media.drawn(vectors, "vec_id", "embedding"), "vec_id", "data"))
    firsts = vectors.join(members.select(F.col("class_id").alias("vec_id")).distinct(), "vec_id", "left_semi")
    found = media.find_copies(edited, media.drawn(firsts, "vec_id", "embedding"), "vec_id", "data", folded=True)
    matches = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("class_id", "votes"))).alias("m"))
    rows = members.withColumnRenamed("id", "vec_id").join(matches, "vec_id", "left")
    return rows.select("vec_id", "class_id", F.coalesce(F.size("m"), F.lit(0)).alias("n_matches"), F.transform("m", lambda m: m["class_id"]).alias("matches"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = pii.pseudonymise(docs, key="corpus-key")
    return done.select("doc_id", "text", *[F.col(f"pii_counts.{k}").alias(f"n_{k}") for k in pii.TYPES])


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no fetch times and no list: a page is fetched on a day given by its id, and a host is listed, and delisted, by its digest."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 365).cast("int")))
    hosts = pages.select(urls.host_of(F.col("url")).alias("host")).dropna().distinct()
    known = hosts.select(F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("domain")).where("domain <> ''").distinct()
    number = lambda i, n: F.conv(F.substring(F.md5("domain"), i, 4), 16, 10).cast("int") % n
    since = F.date_add(F.lit("2024-01-01").cast("date"), number(1, 300))
    chosen = known.where(number(5, 4) == 0)
    entries = chosen.select("domain", since.alias("at"), F.lit(True).alias("listed")).unionByName(
        chosen.where(number(9, 2) == 0).select("domain", F.date_add(since, number(13, 120) + 1).alias("at"), F.lit(False).alias("listed")))
    judged = urls.filter_urls(captures, entries)
    return judged.select("page_id", "url", F.col("fetched_at").cast("string").alias("fetched_at"), "blocked", "entry", F.col("listed_since").cast("string").alias("listed_since"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_bucket("doc_id", 3) == 1, F.lit(False))
    net = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = quality.score_quality(docs, net, keep=("doc_id",))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), F.when(F.col("quality_score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents have no paths: a document lies in a directory given by its source and id, every tenth is that directory's licence file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    place = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.format_string("p%d", F.expr("doc_id div 1000")), F.format_string("m%d", F.expr("doc_id div 20")))
    path = F.concat(place, F.when(F.col("doc_id") % 10 == 0, "/LICENSE").otherwise(F.format_string("/f%d.txt", "doc_id")))
    scanned = licenses.scan_licenses(docs.withColumn("path", path), keep=("doc_id", "path"))
    return licenses.inherit(scanned).select("doc_id", "path", "own_license", "cosine", "license", "license_from")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pages to an archive in the shared folder and reads it back; a revisit's size and digest are those that its record states."""
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    revisit = F.col("type") == "revisit"
    return warc.read_archive(spark, path).select(
        warc.id_of(F.col("record_id")).cast("bigint").alias("page_id"), F.when(revisit, F.col("stated_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("stated_digest")).otherwise(F.col("digest")).alias("payload_digest"), F.col("type").alias("record_type"),
        F.when(revisit, warc.id_of(F.col("refers_to")).cast("bigint")).alias("refers_to"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    summary, long = conversations.repair(conversations.damaged(given))
    lines = F.concat_ws("\n", F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])))
    summary = summary.withColumn("here", F.when(F.col("repaired").isNotNull(), F.sha2(lines, 256))).drop("repaired").join(conversations.digests(long), "ck", "left")
    every = given.select("conv_id").distinct().withColumn("ck", conversations.key_of("conv_id"))
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(summary, "ck", "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("here", "sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = filter_audit.flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.audit(cells, ("A", "B", "C", "D", "E"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_simhash_near_dedup, op2_benchmark_decontamination, op3_language_id, op4_secret_scans, op5_media_copies, op6_pii_surrogates,
        op7_url_filters, op8_quality_classifier, op9_license_scans, op10_source_mixing, op11_warc, op12_conversation_repair, op13_filter_audit,
    )}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
