"""URL filters by a temporal list join, with DataFrame functions only.

Dated list entries (domain, listed from then on or not) become validity intervals; an as-of join evaluates
every capture against the entries that were active when it was fetched. A domain covers its subdomains.
Captures are folded into distinct (host, time) pairs, and these into (domain, time) pairs, before the join.
Within a cell of time the state at a moment is the last entry's before it, and a cell starts with the state
that the last cell ended with, so neither a popular nor an often changed domain is one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wardline.llm.common import cut, lookup, named


HOST = r"^[\x00-\x20]*[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?(\[[0-9a-f:.]+\]|[^/?#:@\[\]]+)"


def host_of(url: Column) -> Column:
    """Lower-cased host of an absolute URL without user, port, and final dots; null where there is none. An IPv6 host keeps its brackets."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.lower(url), HOST, 1), r"\.+$", ""), F.lit(""))


def turns(entries: DataFrame, domain: str, at: str, listed: str) -> DataFrame:
    """(domain, at, listed) of the entries that change a domain's state."""
    clean = entries.select(F.regexp_replace(F.lower(F.trim(F.col(domain))), r"\.+$", "").alias("domain"), F.col(at).alias("at"), F.col(listed).cast("boolean").alias("listed")).dropna()
    clean = clean.groupBy("domain", "at").agg(F.bool_or("listed").alias("listed"))
    was = F.lag("listed").over(Window.partitionBy("domain").orderBy("at"))
    return clean.withColumn("was", was).where(F.col("was").isNull() | (F.col("was") != F.col("listed"))).drop("was")


def validity_intervals(entries: DataFrame, domain: str = "domain", at: str = "at", listed: str = "listed") -> DataFrame:
    """(domain, valid_from, valid_to) of the times in which a domain is listed; valid_to is exclusive, null if open.

    Of entries of a domain at one time, listing wins. Entries with a null in any of the three columns
    say nothing and are left out. Repeated entries change nothing.
    """
    ends = F.lead("at").over(Window.partitionBy("domain").orderBy("at"))
    return turns(entries, domain, at, listed).withColumn("valid_to", ends).where("listed").select("domain", F.col("at").alias("valid_from"), "valid_to")


def suffixes(host: Column) -> Column:
    """The host and its parent domains of two labels or more; of a single label or an IP address the host."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host.rlike(r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*)$"), F.array(host)).otherwise(parents)


def _cell(at: Column, kind: T.DataType) -> Column:
    """The month of a date, the day of a time stamp, 86400 steps of a number."""
    if isinstance(kind, T.DateType):
        return F.trunc(at, "month").cast("string")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return at.cast("date").cast("string")
    return F.floor(at.cast("double") / 86400).cast("string") if isinstance(kind, T.NumericType) else F.substring(at.cast("string"), 1, 7)


def as_of(asked: DataFrame, states: DataFrame) -> DataFrame:
    """(domain, at, state) for distinct (domain, at) of `asked`: the last state of `states` (domain, at, listed) then, null before the first."""
    kind = asked.schema["at"].dataType
    state = F.struct("listed", F.col("at").alias("since"))
    events = asked.select("domain", "at", F.lit(1).alias("asks"), F.lit(None).cast(T.StructType([T.StructField("listed", T.BooleanType()), T.StructField("since", kind)])).alias("state")).unionByName(
        states.select("domain", F.col("at").cast(kind).alias("at"), "listed").select("domain", "at", F.lit(0).alias("asks"), state.alias("state")))
    events = events.withColumn("cell", _cell(F.col("at"), kind))
    within = F.last("state", True).over(Window.partitionBy("domain", "cell").orderBy("at", "asks"))
    cells = events.groupBy("domain", "cell").agg(F.min("at").alias("first"), F.max_by("state", F.when(F.col("asks") == 0, F.col("at"))).alias("last"))
    carried = F.last("last", True).over(Window.partitionBy("domain").orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    before = cells.select("domain", "cell", carried.alias("carried"))
    found = events.withColumn("here", within).where("asks = 1").select("domain", "at", "cell", "here")
    return found.join(before, ["domain", "cell"]).select("domain", "at", F.coalesce("here", "carried").alias("state"))


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns `keep` of `captures` (by default all), `blocked`, `entry` and `listed_since`.

    `entry` is the longest domain that covered the host at fetch time. A null or relative URL, or a null
    time, is not blocked. Repeated captures are judged alike; empty captures give an empty result; an
    empty list blocks nothing. Columns named like the three give way to them.
    """
    kept = named(captures, keep, ("blocked", "entry", "listed_since"))
    rows = captures.select(*[captures[c].alias(f"c{i}") for i, c in enumerate(kept)], host_of(captures[url_col]).alias("host"), captures[time_col].alias("at"))
    pairs = rows.select("host", "at").dropna().distinct()
    changes = cut(turns(entries, "domain", "at", "listed"))
    tried = pairs.select("host", "at", F.explode(suffixes(F.col("host"))).alias("domain")).join(changes.select("domain").distinct(), "domain", "left_semi")
    tried = cut(tried)
    listed = as_of(tried.select("domain", "at").distinct(), changes).where("state.listed").select("domain", "at", "state.since")
    best = tried.join(listed, ["domain", "at"]).groupBy("host", "at").agg(F.max(F.struct(F.length("domain").alias("n"), "domain", "since")).alias("b"))
    verdicts = best.select("host", "at", F.col("b.domain").alias("entry"), F.col("b.since").alias("listed_since"))
    # One key of host and time: lookup splits hot ones, and keeps what has no host or time out of the join.
    pair = F.concat(F.col("host"), F.lit("\n"), F.col("at").cast("string"))
    judged = lookup(rows.withColumn("pair", pair), cut(verdicts.select(pair.alias("pair"), "entry", "listed_since")), "pair", "left")
    return judged.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col("entry").isNotNull().alias("blocked"), "entry", "listed_since")
