"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

A record is one row of Spark's text sink, whose line separator closes it. The reader cuts files into
pieces at every "WARC/1." that begins a line, wherever that stands, so archives are split among tasks
and no file is read whole. A piece is only a candidate: html may hold such bytes. Each candidate emits
its offset and, from its Content-Length, its successor's; pointer jumping from the start of every
file then keeps what can be reached, in as many rounds as the logarithm of the longest chain.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.llm.common import cut, renewed, shared_folder

END = "\r\n\r\n"
#: The reader's separator. Its first character does not come again, as Hadoop's reader may miss a separator with
#: such a repeat where its buffers meet.
MAGIC = "\nWARC/1."
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Groups of equal payloads up to which all are broadcast (about 100 bytes each).
FEW = 100_000


def _urn(value: Column) -> Column:
    """A null id has an urn of its own, which no other id can have."""
    return F.coalesce(F.concat(F.lit("<urn:record:"), F.url_encode(value.cast("string")), F.lit(">")), F.lit("<urn:no-record>"))


def id_of(urn: Column) -> Column:
    """The id in an urn as text, null for the urn of a null id."""
    return F.url_decode(F.regexp_extract(F.when(urn.startswith("urn:record:"), urn), "^urn:record:(.*)$", 1))


def first_of_equals(sized: DataFrame, at_least: int) -> DataFrame:
    """`sized` with `__target`, the largest id of the payload's equals; null where it has none or is too small.

    Only groups of two or more are kept. Up to FEW of them are broadcast; of more, those of over a
    thousandth of the rows are, and the others are shuffled, so a payload that a third of all pages
    have is never one task.
    """
    groups = sized.where(F.col("__bytes") >= at_least).groupBy("__same").agg(F.count("*").alias("__n"), F.max("__id").alias("__target")).where("__n > 1")
    groups = cut(groups)
    values = groups.select("__same", "__target")
    if groups.count() <= FEW:
        return sized.join(F.broadcast(values), "__same", "left")
    total = groups.agg(F.sum("__n")).first()[0]
    hot = groups.where(F.col("__n") > total // 1000)
    split = sized.join(F.broadcast(hot.select("__same", F.col("__target").alias("__hot"), F.lit(True).alias("__is_hot"))), "__same", "left")
    # A row that needs no other group gets a key that no group has, so those rows spread.
    free = F.col("__is_hot").isNotNull() | (F.col("__bytes") < at_least)
    split = split.withColumn("__key", F.when(free, F.concat(F.lit("-"), "__same", F.xxhash64("__id", "__url").cast("string"))).otherwise(F.col("__same")))
    cold = groups.where(F.col("__n") <= total // 1000).select(F.col("__same").alias("__key"), "__target")
    return split.join(cold, "__key", "left").withColumn("__target", F.coalesce("__target", "__hot"))


def write_archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    at_least: int = 1000, date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Writes one record for every row of `pages` to uncompressed WARC 1.1 files in the new folder `path`.

    Of rows with equal payloads (by SHA-256) of at least `at_least` bytes, that with the largest id is the
    response; the others are revisit records without payload, whose HTTP header still has its length. Rows
    that repeat that id are responses too. A null payload is empty, a null URL leaves out the header, and a
    null id is less than any other. CR and LF in a URL are written %0D and %0A. An empty table gives an
    archive without records. Only the three named columns are read.
    """
    payload = F.coalesce(pages[payload_col].cast("string"), F.lit(""))
    sized = pages.select(
        pages[id_col].alias("__id"), pages[url_col].cast("string").alias("__url"), payload.alias("__payload"),
        F.octet_length(payload).alias("__bytes"), F.sha2(payload.cast("binary"), 256).alias("__same"),
    )
    placed = first_of_equals(sized, at_least)
    revisit = F.col("__target").isNotNull() & (F.col("__bytes") >= at_least) & ~F.col("__id").eqNullSafe(F.col("__target"))
    url = F.replace(F.replace(F.col("__url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(HTTP), F.col("__bytes").cast("string"), F.lit(END))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("__bytes"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _urn(F.col("__id")), F.lit(f"\r\nWARC-Date: {date}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n")), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.sha1(F.col("__payload").cast("binary")),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _urn(F.col("__target")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), block.cast("string"), F.lit(END),
        http, F.when(revisit, "").otherwise(F.col("__payload")),
    )
    placed.select(record.alias("value")).write.option("lineSep", END).text(path)


def _header(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?imd)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1), F.lit(""))


def parsed(value: Column) -> dict[str, Column]:
    """Fields of a record from its bytes after "WARC/1." (as a string): sizes in bytes, null where the header is no header.

    `whole` says whether the block is there; payload and its digest are of a whole block, without its HTTP header.
    """
    head = F.substring_index(value, END, 1)
    start = F.octet_length(head) + 4
    given = F.octet_length(value) - start
    text = _header(head, "Content-Length")
    length = F.when(value.rlike(r"^[01]\r\n") & text.rlike("^[0-9]{1,17}$"), text.try_cast("bigint"))
    whole = F.coalesce(given >= length, F.lit(False))
    is_http = F.lower(_header(head, "Content-Type")).startswith("application/http")
    with_http = F.octet_length(F.substring_index(value, END, 2)) + 4
    skip = F.when(is_http & (with_http <= start + length), with_http).otherwise(start)
    payload = F.when(whole, F.substring(value.cast("binary"), skip + 1, (start + length - skip).cast("int")))
    http_head = F.when(is_http & whole, F.substring_index(F.substring_index(value, END, 2), END, -1))
    urn = lambda name: F.regexp_extract(_header(head, name), "^<?([^>]*)>?$", 1)
    return {
        "size": F.octet_length(head) + 4 + length + 4, "whole": whole, "type": F.lower(_header(head, "WARC-Type")),
        "record_id": urn("WARC-Record-ID"), "uri": _header(head, "WARC-Target-URI"), "refers_to": urn("WARC-Refers-To"),
        "stated_digest": F.regexp_replace(_header(head, "WARC-Payload-Digest"), "^(?i)sha1:", ""),
        "stated_bytes": _header(http_head, "Content-Length").try_cast("bigint"),
        "payload": payload, "payload_bytes": F.octet_length(payload).cast("bigint"), "digest": F.sha1(payload),
    }


FIELDS = ("type", "record_id", "uri", "refers_to", "stated_digest", "stated_bytes", "payload_bytes", "digest")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, nth, value) for the runs between separators; `value` starts after "WARC/1.", also at the file's start.

    `opens` tells a piece that begins as a file must from one that follows a separator.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), "value",
    )
    opens = F.col("value").startswith("WARC/1.")
    return raw.select("file", "block", "nth", opens.alias("opens"), F.octet_length("value").cast("bigint").alias("bytes"), F.when(opens, F.expr("substring(value, 8)")).otherwise(F.col("value")).alias("value"))


def _placed(pieces: DataFrame) -> DataFrame:
    """`pieces` with `start`, their value's offset (0 where the file starts), and `total`, the file's length: sums within blocks, then over the blocks of a file."""
    step = F.col("bytes") + len(MAGIC)
    inside = Window.partitionBy("file", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = pieces.groupBy("file", "block").agg(F.sum(step).alias("sum"))
    blocks = blocks.select("file", "block", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"), (F.sum("sum").over(Window.partitionBy("file")) - len(MAGIC)).alias("total"))
    start = F.col("base") + F.coalesce(F.sum(step).over(inside), F.lit(0))
    return pieces.join(blocks, ["file", "block"]).withColumn("start", start).drop("base", "nth")


def _at(start: Column) -> Column:
    """The offset of the record whose value starts at `start`."""
    return F.when(start == 0, 0).otherwise(start - 7)


def reachable(links: DataFrame) -> DataFrame:
    """The (file, at) that a walk from offset 0 of their file visits, of `links` (file, at, to), by pointer jumping.

    After k rounds every link leads 2^k records on, and the first 2^k records of a file are marked. A walk
    ends where `to` is no candidate. Offsets only grow, so there are no cycles; nulls lead nowhere.
    """
    folder, turn = f"{shared_folder(links.sparkSession)}/reachable-{uuid.uuid4().hex}", 0
    state = renewed(links.select("file", "at", F.col("to").alias("jump"), (F.col("at") == 0).alias("seen")), folder, turn)
    while not state.where("seen and jump is not null").isEmpty():
        onward = state.select("file", F.col("at").alias("jump"), F.col("jump").alias("next"), F.lit(True).alias("there"))
        marks = state.where("seen").select("file", F.col("jump").alias("at"), F.lit(True).alias("marked"))
        turn += 1
        # The files are far smaller than their rows in memory, so none of them may be broadcast by its size.
        state = renewed(
            state.join(onward.hint("merge"), ["file", "jump"], "left").join(marks.hint("merge"), ["file", "at"], "left")
            .select("file", "at", F.when(F.col("there"), F.col("next")).alias("jump"), (F.col("seen") | F.coalesce("marked", F.lit(False))).alias("seen")),
            folder, turn,
        )
    return state.where("seen").select("file", "at")


def read_archive(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of the WARC files in `path` that a chain from the start of their file reaches.

    (file, at, type, record_id, uri, refers_to, stated_digest, stated_bytes, payload_bytes, digest):
    `at` is the record's offset, the stated ones are what its headers say, `payload_bytes` and `digest`
    (SHA-1) what its payload has; `payloads` adds the bytes as `payload`. A chain breaks at a record
    without a length, and a record that runs over the file's end is left out. A record whose payload
    holds separators is put together from its pieces, which are read again in the files that have any.
    Empty folders and files give no rows. Uncompressed files are split; Spark reads .gz ones whole.
    """
    pieces = _pieces(spark, path)
    fields = parsed(F.col("value"))
    narrow = pieces.select("file", "block", "nth", "opens", "bytes", *[fields[c].alias(c) for c in ("size", "whole", *FIELDS)])
    placed = _placed(narrow).where(F.col("opens") == (F.col("start") == 0)).withColumn("at", _at(F.col("start")))
    found = cut(placed.withColumn("to", F.col("at") + 7 + F.col("size")))
    fits = found.where("size is not null and to <= total")
    chain = cut(fits.join(reachable(fits.select("file", "at", "to")).hint("merge"), ["file", "at"]).select("file", "at", "to", "whole", *FIELDS))
    whole, broken = chain.where("whole"), chain.where("not whole")
    if payloads:
        whole, broken = whole.where("false").withColumn("payload", F.lit(None).cast("binary")), chain
    columns = ["file", "at", *FIELDS, *(["payload"] if payloads else [])]
    if broken.isEmpty():
        return whole.select(*columns)
    return whole.select(*columns).unionByName(_assembled(pieces, broken.select("file", "at", "to"), columns))


def _assembled(pieces: DataFrame, broken: DataFrame, columns: list[str]) -> DataFrame:
    """The records `broken` (file, at, to), parsed from all pieces between their offsets; a record's pieces meet in one row."""
    again = _placed(pieces.join(broken.select("file").distinct(), "file", "left_semi"))
    value = F.when(F.col("opens") & (F.col("start") > 0), F.concat(F.lit("WARC/1."), "value")).otherwise(F.col("value"))
    starts = broken.select("file", F.when(F.col("at") == 0, 0).otherwise(F.col("at") + 7).alias("start"), F.struct("at", "to").alias("record"))
    # Which record a piece belongs to is found from offsets alone; the bytes are joined to it.
    rows = again.select("file", "start", F.lit(None).cast(starts.schema["record"].dataType).alias("record")).unionByName(starts)
    earlier = Window.partitionBy("file").orderBy("start", F.col("record.at").asc_nulls_last())
    owned = rows.withColumn("own", F.last("record", ignorenulls=True).over(earlier)).where("record is null and start < own.to").select("file", "start", F.col("own.at").alias("at"))
    parts = owned.join(again.select("file", "start", value.alias("value")), ["file", "start"])
    parts = parts.groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("parts"))
    fields = parsed(F.col("value"))
    parts = parts.select("file", "at", F.concat_ws(MAGIC, F.transform("parts", lambda p: p["value"])).alias("value"))
    return parts.select("file", "at", *[fields[c].alias(c) for c in columns[2:]])
