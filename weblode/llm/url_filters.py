"""Temporal list join: URL captures against dated list entries (op 8); DataFrame functions only.

A list is a log of dated entries (rule, action, day): `block` and `allow` put a rule on the list
from that day, `remove` takes it off. The log becomes validity intervals [since, until), one
for each entry in force. A rule is a domain, which covers its subdomains, or a domain and
first path segment. Each capture is held against the entries in force when it was
fetched; the longest rule decides, a longer domain before a shorter one.

Captures are first reduced to their distinct probes (host, first segment, day), so a host with
a third of all captures is a few rows. The as-of step sorts each rule's intervals and probes
together by day and lets every probe look back to the last interval begun, so a rule with a
long history costs no more than its length. Rules that many probes share are dealt to `SALTS`
tasks, with a copy of their intervals each; probes that many captures share are looked up
where the captures are.

Defined results: a null or unparsable url, or a null day, is kept and matches nothing; entries with a null rule,
action or day are ignored; of several entries of a rule on one day a `remove` counts first,
then `allow`, then `block`, and the last of these is in force; repeated captures are answered each;
empty captures give an empty result, an empty list keeps everything; other columns of the
captures are kept as they are, and an answer whose name they have already gets a `_` at its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weblode.llm.spark_io import checkpointed, column, packed

SALTS = 64
#: A rule or probe is frequent if more than this part of all has it; so there are never more frequent ones.
FREQUENT = 1024
FOREVER = 1 << 30


def host_of(url: Column) -> Column:
    """The lower-case host, or null."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(host != "", host)


def segment_of(url: Column) -> Column:
    """The first path segment, empty if there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def rule_keys(host: Column, segment: Column) -> Column:
    """All rules that could cover a URL: the host, each parent domain of two labels or more, and host/segment."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.array_distinct(F.concat(parents, F.when(segment != "", F.array(F.concat_ws("/", host, segment))).otherwise(F.array().cast("array<string>"))))


def intervals(entries: DataFrame) -> DataFrame:
    """(rule, action, since, until) of every entry while it is in force."""
    rank = F.when(F.col("action") == "remove", 0).when(F.col("action") == "allow", 1).when(F.col("action") == "block", 2)
    known = entries.select("rule", "action", F.col("day").cast("int").alias("day"), rank.alias("rank")).where("rule IS NOT NULL AND day IS NOT NULL AND rank IS NOT NULL")
    last = known.groupBy("rule", "day").agg(F.max(F.struct("rank", "action")).alias("last")).select("rule", "day", F.col("last.action").alias("action"))
    until = F.lead("day").over(Window.partitionBy("rule").orderBy("day"))
    spans = last.select("rule", "action", F.col("day").alias("since"), F.coalesce(until, F.lit(FOREVER)).alias("until"))
    return spans.where(F.col("action") != "remove")


def _frequent(counted: DataFrame, *keys: str) -> DataFrame:
    """The keys, with a count `times`, that more than one in FREQUENT of all rows have: FREQUENT rows at most."""
    total = counted.agg(F.sum("times")).first()[0] or 0
    return F.broadcast(checkpointed(counted.where(F.col("times") * FREQUENT > total).select(*keys)))


def in_force(probes: DataFrame, entries: DataFrame) -> DataFrame:
    """(host, segment, day, hit) of the probes that an interval in force covers; the longest rule decides."""
    keyed = probes.select("host", "segment", "day", F.explode(rule_keys(F.col("host"), F.col("segment"))).alias("rule"))
    hot = _frequent(keyed.groupBy("rule").agg(F.count("*").alias("times")), "rule").withColumn("hot", F.lit(True))
    salted = keyed.join(hot, "rule", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("host", "segment", "day"), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    copies = F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    listed = intervals(entries).join(hot, "rule", "left").withColumn("salt", F.explode(copies))
    interval = F.struct("action", "since", "until")
    begun = listed.select("rule", "salt", F.col("since").alias("at"), F.lit(0).alias("asks"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("segment"), interval.alias("interval"))
    asking = salted.select("rule", "salt", F.col("day").alias("at"), F.lit(1).alias("asks"), "host", "segment", F.lit(None).cast(begun.schema["interval"].dataType).alias("interval"))
    so_far = Window.partitionBy("rule", "salt").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    looked = begun.unionByName(asking).withColumn("interval", F.last("interval", ignorenulls=True).over(so_far))
    met = looked.where("asks = 1 AND at < interval.until")
    best = F.max(F.struct(F.length("rule").alias("size"), "rule", "interval.action", "interval.since")).alias("hit")
    return met.groupBy("host", "segment", F.col("at").alias("day")).agg(best)


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetch_day") -> DataFrame:
    """The captures with host, decision (block, allow or keep), matched_rule and listed_since."""
    rows = packed(captures, host=host_of(column(url)), segment=segment_of(column(url)), day=column(day).cast("int"))
    known = F.col("host").isNotNull() & F.col("day").isNotNull()
    key = ["host", "segment", "day"]
    probes = checkpointed(rows.where(known).groupBy(*key).agg(F.count("*").alias("times")))
    hits = checkpointed(in_force(probes, entries))
    hot = _frequent(probes, *key)
    some = rows.where(known)
    answered = (
        some.join(hot, key, "left_semi").join(F.broadcast(hits.join(hot, key, "left_semi")), key, "left")
        .unionByName(some.join(hot, key, "left_anti").join(hits.join(hot, key, "left_anti"), key, "left"))
        .unionByName(rows.where(~known), allowMissingColumns=True)
    )
    answers = {"host": F.col("host"), "decision": F.coalesce(F.col("hit.action"), F.lit("keep")), "matched_rule": F.col("hit.rule"), "listed_since": F.col("hit.since")}
    taken = {c.lower() for c in captures.columns}
    named = [c.alias(n + "_" if n in taken else n) for n, c in answers.items()]
    return answered.select(*(F.col("row")[c].alias(c) for c in captures.columns), *named)


def demo_entries(urls: DataFrame) -> DataFrame:
    """A list for tables that come without one: entries of every host, parent domain and host/segment, by their MD5.

    A quarter of the rules is blocked for good, a quarter blocked and removed, a quarter
    blocked, removed and allowed, a quarter never listed.
    """
    hosts = urls.select(host_of(F.col("url")).alias("host"), segment_of(F.col("url")).alias("segment")).where("host IS NOT NULL").distinct()
    rules = hosts.select(F.explode(rule_keys(F.col("host"), F.col("segment"))).alias("rule")).distinct()
    v = F.conv(F.substring(F.md5(F.col("rule").cast("binary")), 1, 7), 16, 10).cast("int")
    entry = lambda action, at: F.struct(F.lit(action).alias("action"), at.cast("int").alias("day"))
    start = v % 200
    log = (
        F.when(v % 4 == 0, F.array(entry("block", start)))
        .when(v % 4 == 1, F.array(entry("block", start), entry("remove", start + 30 + v % 90)))
        .when(v % 4 == 2, F.array(entry("block", start), entry("remove", start + 20), entry("allow", start + 20 + v % 50)))
        .otherwise(F.array().cast("array<struct<action:string,day:int>>"))
    )
    return rules.select("rule", F.inline(log))
