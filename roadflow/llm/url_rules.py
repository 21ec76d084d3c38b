"""URL filters: a sort-merge range join of URLs with prefix rules, in DataFrame functions only.

A canonical key is the host's labels in reverse, a slash, then the path: ``org.example/`` + ``/es/1``. A rule on a host and a
path prefix is the interval of all keys with its key as prefix; within one host such intervals are nested or disjoint. A sorted sweep
over a host's interval ends keeps the stack of open rules: its height is a running count of opened less closed ones, and its entry at a
height is the rule last opened there. So each end knows which rule is innermost from it on: the one it opens, or the entry below the
one it closes. A URL enters with one key for each suffix of its host that is a rule's host, whatever its depth; URLs' keys and interval
ends are sorted together, and the last end before a key names its innermost rule. The longest rule over all suffixes wins.

Only distinct pairs of host and path that some rule's host fits go through the sweep, and the answers are joined back. A host's share of
them decides over how many salts it is dealt out, so a host with most of the rows fills many partitions, and its rules are copied to no more
than these. All steps are sorts, windows and joins, which spill; no list of rules is ever built, and no number of rules or of labels is too large.

Defined results: NULL URLs and those without ``://`` have empty host and path, match no rule and get the default verdict. Equal
rows stay separate rows. Of equal rules with different verdicts ``block`` holds. Between rules of equal length on nested hosts
the longer host wins. Further columns of the pages are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _key(host: Column, path: Column) -> Column:
    return F.concat(_reversed_host(host), F.lit("/"), path).cast("binary")


def interval_ends(rules: DataFrame) -> DataFrame:
    """(suffix, key, open): from each interval end on, ``open`` is the innermost rule there, or a struct of NULLs.

    rules: verdict, host, path.
    """
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rule = F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("deep"), F.concat("host", "path").alias("rule"), "verdict")
    rules = rules.select(F.col("host").alias("suffix"), _key(F.col("host"), F.col("path")).alias("key"), rule.alias("rule"))
    after = F.concat(F.col("key"), F.unhex(F.lit("FF")))  # no key has such a byte
    ends = F.array(F.struct(F.col("key").alias("at"), F.lit(1).alias("step")), F.struct(after.alias("at"), F.lit(-1).alias("step")))
    swept = Window.partitionBy("suffix").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = rules.withColumn("end", F.explode(ends)).select("suffix", "key", "rule", "end.*").withColumn("height", F.sum("step").over(swept)).filter("step = 1")
    # a rule at a height asks for the one last opened at the height below
    asks = F.array(F.struct(F.col("height").alias("level"), F.col("rule").alias("entry")), F.struct((F.col("height") - 1).alias("level"), F.lit(None).cast(rules.schema["rule"].dataType).alias("entry")))
    stack = Window.partitionBy("suffix", "level").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = opened.withColumn("ask", F.explode(asks)).select("suffix", "key", "rule", "ask.*").withColumn("below", F.last("entry", ignorenulls=True).over(stack)).filter("entry IS NULL")
    none = F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in rules.schema["rule"].dataType.fields))
    ends = F.array(F.struct(F.col("key").alias("key"), F.col("rule").alias("open")), F.struct(after.alias("key"), F.coalesce("below", none).alias("open")))
    return below.select("suffix", F.inline(ends))


def judge(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", salts: int | None = None) -> DataFrame:
    """id, host, path, rule and verdict of each page. salts: over how many a host with all rows would be dealt out."""
    salts = salts or 2 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    depths = rules.agg(F.collect_set(F.size(F.split("host", r"\."))).alias("depths")).scalar()  # a number for each depth of rules' hosts
    own = F.transform(F.filter("depths", lambda d: d <= F.size(labels)), lambda d: F.array_join(F.slice(labels, -d, d), "."))
    hosts = rules.select(F.col("host").alias("suffix")).distinct()
    keys = urls.select("host", "path").distinct().withColumn("depths", depths).select("host", "path", F.explode(own).alias("suffix")).join(hosts, "suffix")
    share = keys.groupBy("suffix").agg(F.count("*").alias("n"))
    share = share.select("suffix", F.ceil(F.col("n") * salts / share.agg(F.sum("n")).scalar()).cast("int").alias("salts"))
    ends = interval_ends(rules)
    kind = ends.schema["open"].dataType
    probes = keys.join(share, "suffix").withColumn("salt", F.pmod(F.xxhash64("host", "path"), "salts").cast("int"))
    probes = probes.select("suffix", "salt", _key(F.col("suffix"), F.col("path")).alias("key"), F.lit(1).alias("is_url"), F.lit(None).cast(kind).alias("open"), "host", "path")
    marks = ends.join(share, "suffix").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    marks = marks.select("suffix", "salt", "key", F.lit(0).alias("is_url"), "open", *(F.lit(None).cast("string").alias(c) for c in ("host", "path")))
    swept = Window.partitionBy("suffix", "salt").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = probes.unionByName(marks).withColumn("met", F.last("open", ignorenulls=True).over(swept)).filter("is_url = 1 AND met.rule IS NOT NULL")
    best = met.groupBy("host", "path").agg(F.max("met").alias("met"))
    return urls.join(best, ["host", "path"], "left").select(F.col("id").alias(id_col), "host", "path", F.col("met.rule").alias("rule"), F.coalesce("met.verdict", F.lit(default)).alias("verdict"))
