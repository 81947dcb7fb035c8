"""URL filters by a sort-merge range join (DataFrame functions only).

A rule is a host and a path prefix; it fits its host and all subdomains if the url's path
starts with its path. A url is expanded to one key per suffix of its host, so that a rule
fits iff it has the host of one of these keys and its path is a prefix of theirs. With the
reversed host in front, each rule is then one interval of canonical keys
``reversed host / path bytes`` .. ``reversed host / path bytes 0xFF`` (no UTF-8 text holds the
byte 0xFF), and the intervals of a host are nested or disjoint.

A sweep in key order meets starts, urls and ends. The running sum of +1 and -1 is the depth of
the stack of active rules, and the rule on level ``d`` is the last that started with depth
``d``: two window functions over one exchange and no rule list in any row.

A host can hold a third of all urls (a top-level domain does), so the urls of a host with more
than a partition's share of all, or more than SWEEP, are dealt over several sweeps, each with all
rules of the host; the rules of other hosts stay single.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, hot_join, partitions

#: Most urls of one sweep, and so few that no host with them is dealt out.
SWEEP, LEAST = 100_000, 1_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def judge_urls(urls: DataFrame, rules: DataFrame, default: str = "allow", sweep: int = SWEEP) -> DataFrame:
    """The rule that decides each url: page_id, host, path, rule, verdict, a row per input row.

    ``urls``: page_id, url. ``rules``: host, path, verdict. The longest fitting rule (host plus
    path, in characters) wins; of equally long ones that with the longer host. Rules that
    repeat a host and path count once, as ``block`` if any says so. Rules without a host or
    path are left out. A null url, or one without ``://``, has an empty host and path, which no
    rule fits; then ``rule`` is null and the verdict is ``default``. Repeated rows and page ids
    each keep their own row. Without rules every url gets ``default``. Urls of any length are judged whole, other
    columns than page_id and url are not looked at, and an empty table gives no rows.
    """
    r = rules.filter("host is not null and path is not null and host <> ''").select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    r = r.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))  # 'block' > 'allow'
    r = r.withColumn("key_host", _reversed(F.split("rule_host", r"\."))).withColumn("bytes", F.col("rule_path").cast("binary"))

    rows = urls.groupBy("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).agg(F.count("*").alias("copies"))
    labels = F.split("host", r"\.")
    deepest = r.agg(F.coalesce(F.max(F.size(F.split("rule_host", r"\."))), F.lit(0)).alias("deepest"))
    deepest = deepest.first()["deepest"]  # one number; no longer suffix of a host can meet a rule
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(deepest, 1)))), lambda n: _reversed(F.slice(labels, -n, n)))
    keys = rows.filter("host <> ''").select("page_id", "host", "path", F.explode(suffixes).alias("key_host"))
    # the hosts of rules, and over how many sweeps their urls go
    loads = keys.groupBy("key_host").agg(F.count("*").alias("n")).join(r.select("key_host").distinct(), "key_host")
    loads = cut(loads)
    share = (loads.agg(F.sum("n")).first()[0] or 0) // partitions(urls.sparkSession)  # one number
    loads = loads.withColumn("salts", F.ceil(F.col("n") / min(sweep, max(share, LEAST))).cast("int"))
    keys = hot_join(keys, loads, "key_host")

    event = ["key_host", "salt", "bytes", "kind", "step", "page_id", "host", "path", "rule"]
    rule = F.struct((F.length("rule_host") + F.length("rule_path")).alias("length"), F.length("rule_host").alias("host_length"), F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict"))
    dealt = r.join(loads.select("key_host", "salts"), "key_host").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumns({"rule": rule, "page_id": F.lit(None).cast(dict(urls.dtypes)["page_id"]), "host": F.lit(""), "path": F.lit("")})
    starts = dealt.withColumns({"kind": F.lit(0), "step": F.lit(1)})
    ends = dealt.withColumns({"kind": F.lit(2), "step": F.lit(-1), "bytes": F.concat("bytes", F.unhex(F.lit("FF")))})
    asked = keys.withColumns({"salt": F.pmod(F.xxhash64("page_id", "host", "path"), F.col("salts")).cast("int"), "bytes": F.col("path").cast("binary"), "kind": F.lit(1), "step": F.lit(0), "rule": F.lit(None).cast(dealt.schema["rule"].dataType)})
    events = starts.select(event).union(asked.select(event)).union(ends.select(event))

    sweep = W.partitionBy("key_host", "salt").orderBy("bytes", "kind")
    level = W.partitionBy("key_host", "salt", "depth").orderBy("bytes", "kind")
    running = lambda w: w.rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = events.withColumn("depth", F.sum("step").over(running(sweep)))
    swept = swept.withColumn("top", F.last(F.when(F.col("kind") == 0, F.col("rule")), ignorenulls=True).over(running(level)))
    found = swept.filter("kind = 1 and depth > 0").select("page_id", "host", "path", "top", F.lit(None).cast("long").alias("copies"))

    # the winner of a url among its suffixes, beside the url itself
    alone = rows.select("page_id", "host", "path", F.lit(None).cast(found.schema["top"].dataType).alias("top"), "copies")
    best = alone.union(found).groupBy("page_id", "host", "path").agg(F.max("top").alias("top"), F.max("copies").alias("copies"))
    out = best.select("page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"), "copies")
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
