"""URL filters: rules on reversed hosts and paths as intervals, met by sorted URLs in one sweep.

A rule is a host, a path prefix and a verdict; it fits its host and every subdomain, where the URL's path starts with
the rule's. The canonical key of a rule is its host's labels in reverse order, then its path, so that what it fits is
an interval of sorted keys: all that start with it. A URL has one key for each of its host's ancestors. Per ancestor
the sorted sweep carries along the stack of rules open at the latest rule start; intervals nest, so the rules that
hold for a key are those of that stack whose path the key's path starts with.

Rows: a null URL, or one without "://", has an empty host and path and takes the default verdict. Rules that repeat a
host and path count once, and block wins over allow. Among fitting rules the longest host and path wins. An empty
table of pages or rules is fine. Each page row is kept as often as it comes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
DEFAULT_VERDICT = "allow"
SWEEP_ROWS = 20_000


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path of the URL column."""
    from .common import lower_ascii

    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url)))
    return pages.withColumns(
        {
            "host": F.coalesce(lower_ascii(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.lit("")),
            "path": F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit("")),
        }
    )


def _node(labels):
    return F.array_join(F.reverse(labels), ".")


def rule_stacks(rules: DataFrame) -> DataFrame:
    """node, path and open: the rules of the same node that are open where this rule starts, itself included."""
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.select(_node(F.split("host", "\\.")).alias("node"), "host", "path", "verdict")
    starts = rules.select("node", "path", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n"))
    starts = starts.select("node", F.col("path").alias("start"), F.expr("substring(path, 1, n)").alias("path"))
    opened = starts.join(rules, ["node", "path"])
    return opened.groupBy("node", F.col("start").alias("path")).agg(
        F.collect_list(F.struct((F.length("host") + F.length("path")).alias("size"), F.concat("host", "path").alias("rule"), "path", "verdict")).alias("open")
    )


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT_VERDICT, sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """The pages with host, path, rule and verdict.

    URLs are judged once per distinct host and path. The sweep of a node that many URLs share (a top-level domain) is
    dealt over parts of about `sweep_rows` URLs, each with its own copy of the node's rules.
    """
    pages = with_host_and_path(pages, url)
    stacks = rule_stacks(rules)
    keys = pages.select("host", "path").distinct()
    labels = F.reverse(F.split("host", "\\."))
    deepest = rules.agg(F.max(F.size(F.split("host", "\\."))).alias("n")).first()["n"] or 0  # one number
    # Only nodes no deeper than the deepest rule can have rules.
    ancestors = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(deepest, 1)))), lambda n: F.array_join(F.slice(labels, 1, n), "."))
    visits = keys.select("host", "path", F.explode(ancestors).alias("node"))
    salts = visits.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / sweep_rows).cast("int").alias("salts")).join(stacks.select("node").distinct(), "node", "left_semi")
    visits = visits.join(salts, "node").withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.col("salts")).cast("int")).drop("salts")
    starts = stacks.join(salts, "node").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    events = visits.withColumn("kind", F.lit(1)).unionByName(starts.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    sweep = Window.partitionBy("node", "salt").orderBy("path", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("open", F.last("open", ignorenulls=True).over(sweep)).where("kind = 1")
    fits = F.filter("open", lambda rule: F.startswith(F.col("path"), rule["path"]))
    best = swept.select("host", "path", F.array_max(fits).alias("_best")).where("_best is not null").groupBy("host", "path").agg(F.max("_best").alias("_best"))
    judged = pages.join(best, ["host", "path"], "left")
    return judged.withColumns({"rule": F.col("_best.rule"), "verdict": F.coalesce("_best.verdict", F.lit(default))}).drop("_best")
