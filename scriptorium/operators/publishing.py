"""What a site publishes about itself: where old addresses lead, which pages there are, and its places on a map."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import xml_escaped
from ..sources.scratch import discard, written

# Fixed value: entries of a sitemap file at most.
ENTRIES = 50_000
# Fixed value: the latitude at which the map's square ends.
NORTH = 85.05112878


def resolved(redirects: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """old, target (the end of its chain), hops and state: 'ok', or 'cycle' where the chain has no end; target and hops are
    then null.

    Pointers are doubled: each round a row takes over where its target points to, so that chains of n steps end after
    log2(n) rounds; what has not ended after as many rounds as the table could need goes round. A round is one join,
    written to the shared folder. Rows with a null are not taken; of rows with one old address the smallest new one is.
    """
    rows = redirects.where(F.col(old).isNotNull() & F.col(new).isNotNull()).groupBy(F.col(old).alias("old")).agg(F.min(new).alias("target"))
    rows = written(rows.withColumn("hops", F.lit(1).cast("long")), "redirects")
    for _ in range(rows.count().bit_length() + 1):
        ahead = rows.select(F.col("old").alias("target"), F.col("target").alias("next"), F.col("hops").alias("more"))
        moved = written(rows.join(ahead, "target", "left").select("old", F.coalesce("next", "target").alias("target"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("next").isNotNull().alias("on")), "redirects")
        discard(rows)
        rows = moved.drop("on")
        rows.written_path = moved.written_path
        if not moved.where("on").limit(1).count():
            break
    left = rows.join(rows.select(F.col("old").alias("target"), F.lit(True).alias("goes_on")), "target", "left")
    ended = F.col("goes_on").isNull()
    return left.select("old", F.when(ended, F.col("target")).alias("target"), F.when(ended, F.col("hops")).alias("hops"), F.when(ended, "ok").otherwise("cycle").alias("state"))


def numbered(rows: DataFrame, order: str, name: str = "n") -> DataFrame:
    """The rows with their place from 1 in an order without ties, over the whole table: rows are dealt to ranges, numbered within
    theirs, and moved on by the counts of the ranges before. The driver gets one row a range."""
    dealt = written(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    before, total = [], 0
    for r in sorted(dealt.groupBy("_range").count().collect()):
        before.append((r["_range"], total))
        total += r["count"]
    offsets = rows.sparkSession.createDataFrame(before, "_range int, _before long")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return dealt.withColumn("_own", own).join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def sitemap(pages: DataFrame, url: str, changed: str | None = None, most: int = ENTRIES) -> DataFrame:
    """file (from 1), entries and xml of each sitemap file, by address; a page that repeats is listed once, with its latest
    change. Pages without an address are not listed."""
    known = pages.where(F.col(url) != "").groupBy(F.col(url).alias("loc")).agg((F.max(changed) if changed else F.max(F.lit(None).cast("string"))).cast("string").alias("lastmod"))
    entry = F.concat(F.lit("<url><loc>"), xml_escaped(F.col("loc")), F.lit("</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), F.substring("lastmod", 1, 10), F.lit("</lastmod>")), F.lit("")), F.lit("</url>"))
    placed = numbered(known, "loc").select("n", entry.alias("entry"), F.floor((F.col("n") - 1) / most).cast("long").alias("file"))
    # A file is a group of at most `most` entries.
    files = placed.groupBy("file").agg(F.count(F.lit(1)).alias("entries"), F.array_sort(F.collect_list(F.struct("n", "entry"))).alias("own"))
    body = F.array_join(F.transform("own", lambda e: e["entry"]), "\n")
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'
    return files.select((F.col("file") + 1).alias("file"), "entries", F.concat(F.lit(head), body, F.lit("\n</urlset>\n")).alias("xml"))


def sitemap_index(files: DataFrame, address: str) -> DataFrame:
    """The one file that names the others, file k being at `address` with k in place of {}."""
    before, after = address.split("{}")
    names = files.agg(F.array_sort(F.collect_list("file")).alias("f"))  # one number for 50,000 pages
    lines = F.transform("f", lambda k: F.concat(F.lit(f"<sitemap><loc>{before}"), k.cast("string"), F.lit(f"{after}</loc></sitemap>")))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'
    return names.select(F.concat(F.lit(head), F.array_join(lines, "\n"), F.lit("\n</sitemapindex>\n")).alias("xml"))


def clustered(points: DataFrame, key: str, lat: str, lon: str, deepest: int = 12) -> DataFrame:
    """zoom, x, y (the map tile), n, lat, lon (the pins' centre) and key (the pin's own, where it is alone) of each cluster
    at each zoom from 0 to `deepest`. Each zoom is added up from the one below it. Points without coordinates, or beyond
    the map's edge, are no pins."""
    side = 1 << deepest
    known = points.where(F.col(lat).between(-NORTH, NORTH) & F.col(lon).between(-180.0, 180.0))
    angle = F.radians(lat)
    x = F.least(F.floor((F.col(lon) + 180.0) / 360.0 * side), F.lit(side - 1))
    y = F.least(F.greatest(F.floor((1.0 - F.ln(F.tan(angle) + 1.0 / F.cos(angle)) / F.pi()) / 2.0 * side), F.lit(0)), F.lit(side - 1))
    level = known.select(x.alias("x"), y.alias("y"), F.lit(1).cast("long").alias("n"), F.col(lat).alias("lats"), F.col(lon).alias("lons"), F.col(key).alias("key"))
    out = None
    for zoom in range(deepest, -1, -1):
        sums = [F.sum("n").alias("n"), F.sum("lats").alias("lats"), F.sum("lons").alias("lons"), F.min("key").alias("key")]
        level = written(level.groupBy("x", "y").agg(*sums), f"zoom{zoom}")
        own = level.select(F.lit(zoom).alias("zoom"), "x", "y", "n", F.round(F.col("lats") / F.col("n"), 6).alias("lat"), F.round(F.col("lons") / F.col("n"), 6).alias("lon"), F.when(F.col("n") == 1, F.col("key")).alias("key"))
        out = own if out is None else out.unionByName(own)
        level = level.withColumns({"x": F.shiftright("x", 1), "y": F.shiftright("y", 1)})
    return out
