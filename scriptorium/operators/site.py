"""The site's query operators: faceted ranked search, lookups, fees, access rules, paging, feeds, points in polygons."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, TOKEN, jaccard, let, plain, rfc2822, token_list, trigrams, xml_escaped

# Steps of the fee base (from, base, share of what exceeds it), its cap, and the proceedings.
FEE_STEPS = [(497.92, 6.64, 0.01), (4979.20, 51.46, 0.005), (24896.02, 151.05, 0.0025)]
FEE_CAP = 663.61
PROCEEDINGS = [
    ("civil_complaint", 1.0, "Tužba (parnica, prvostupanjski)", "Civil complaint (first instance)", "Tarifni br. 1"),
    ("civil_judgment", 2.0, "Presuda (parnica, prvostupanjski)", "Civil judgment (first instance)", "Tarifni br. 2"),
    ("civil_appeal", 1.5, "Žalba u parnici", "Civil appeal", "Tarifni br. 7"),
    ("civil_revision", 2.0, "Revizija (Vrhovni sud)", "Revision / cassation (Supreme Court)", "Tarifni br. 9"),
    ("enforcement_order", 0.5, "Prijedlog za ovrhu", "Enforcement order", "Tarifni br. 11"),
    ("enforcement_judgment", 1.0, "Rješenje o ovrsi", "Enforcement judgment", "Tarifni br. 12"),
    ("commercial_complaint", 1.5, "Tužba (Trgovački sud, prvostupanjski)", "Commercial complaint (first instance)", "Tarifni br. 1 (trgovački)"),
    ("commercial_judgment", 3.0, "Presuda (Visoki trgovački sud)", "Commercial judgment (High Commercial Court)", "Tarifni br. 2 (trgovački)"),
    ("bankruptcy_petition", 1.5, "Stečajni prijedlog", "Bankruptcy petition", "Tarifni br. 31"),
    ("land_registry", 0.5, "Zemljišnoknjižni zahtjev", "Land registry request", "Tarifni br. 24"),
    ("administrative", 1.0, "Tužba (Upravni sud)", "Administrative court complaint", "Tarifni br. 21"),
    ("constitutional", 1.0, "Ustavna tužba", "Constitutional complaint", "Tarifni br. 35"),
]
# Where coordinates are taken from, and what a contact may be about.
LATITUDE, LONGITUDE = (42.0, 47.0), (13.5, 19.5)
BLANKS = "".join(c for c in map(chr, range(0x3001)) if unicodedata.category(c) == "Zs")
SUBJECTS = ["general", "technical", "content", "press", "other"]
#: Rows of a name that stand together when they are paired with the rows of similar names.
BLOCK = 1_024


def cents(x: Column) -> Column:
    """Rounded to two digits, halves up."""
    return F.floor(x * 100 + 0.5) / 100


def fee_base(value: Column) -> Column:
    (first, base, _), *_ = FEE_STEPS
    out = F.when(value <= 0, 0.0).when(value <= first, base)
    for (at, start, share), end in zip(FEE_STEPS, [s[0] for s in FEE_STEPS[1:]] + [None], strict=True):
        amount = start + share * (value - at)
        out = out.when(value <= end, amount) if end else out.otherwise(F.least(amount, F.lit(FEE_CAP)))
    return out


def proceedings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROCEEDINGS, "proceeding string, multiplier double, label_hr string, label_en string, tariff string")


def with_fee(claims: DataFrame, value: str, proceeding: str) -> DataFrame:
    """Adds base and fee; both null for an unknown proceeding or a negative value."""
    table = F.broadcast(proceedings(claims.sparkSession).select(F.col("proceeding").alias(proceeding), "multiplier"))
    joined = claims.join(table, proceeding, "left")
    base = F.when(F.col(value) >= 0, cents(fee_base(F.col(value))))
    return joined.withColumn("base", F.when(F.col("multiplier").isNotNull(), base)).withColumn("fee", cents(F.col("base") * F.col("multiplier")))


def facets(equal: dict[str, object], date: str | None = None, since: str | None = None, until: str | None = None) -> Column:
    """All of the facets that are given."""
    found = [F.col(c) == v for c, v in equal.items() if v not in (None, "")]
    found += [F.col(date) >= F.to_timestamp_ntz(F.lit(since))] if date and since else []
    found += [F.col(date) <= F.to_timestamp_ntz(F.lit(until))] if date and until else []
    return reduce(lambda a, b: a & b, found, F.lit(True))


def has_all_words(columns: list[str], words: str) -> Column:
    """Case-insensitive: all words within one of the columns."""
    each = [reduce(lambda a, b: a & b, (F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(w)) for w in words.lower().split()), F.lit(True)) for c in columns]
    return reduce(lambda a, b: a | b, each)


def search(documents: DataFrame, query: str, text: str = "text") -> DataFrame:
    """The rows that have every token of the query, with rank: the share of their tokens that are the query's, 6 digits.

    An empty query finds nothing. Rows without one of the query's words as a plain substring go before any is cut into tokens.
    """
    wanted = token_list(F.lit(query))
    low = F.lower(F.col(text))
    for word in re.findall(TOKEN, query.lower()):
        documents = documents.where(F.contains(low, F.lit(word))) if len(word) > 1 and word not in STOP_WORDS else documents
    hit = lambda tokens: F.size(F.filter(tokens, lambda t: F.array_contains(wanted, t)))
    facts = lambda tokens: F.struct((F.size(wanted) > 0) & F.forall(wanted, lambda t: F.array_contains(tokens, t)), F.round(hit(tokens) / F.size(tokens), 6).alias("rank"))
    # Exploded, not filtered by: else the tokens would be cut for the filter and again for the rank.
    match = F.filter(F.array(let(token_list(F.col(text)), facts)), lambda m: m["col1"])
    return documents.select(*documents.columns, F.explode(match).alias("_m")).select(*documents.columns, F.col("_m.rank").alias("rank"))


def headline(text: Column, word: str, around: int = 15) -> Column:
    """The words around the first one that equals `word` (case aside), that one in <mark>; else the first ones.

    A text is cut and its word looked for once: a lambda's body is evaluated for each element, so neither stands in one.
    """
    bare = lambda w: F.regexp_replace(F.lower(w), "[^\\p{L}\\p{N}-]", "")

    def shown(words: Column, at: Column) -> Column:
        first = F.greatest(at - around, F.lit(1)).cast("int")
        marked = lambda w, i: F.when(i + first == at, F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w)
        return F.array_join(F.transform(F.slice(words, first, F.lit(2 * around)), marked), " ")

    found = lambda words: let(F.coalesce(F.array_position(F.transform(words, bare), word.lower()), F.lit(0)), lambda at: shown(words, at))
    return let(F.split(F.btrim(text, F.lit(BLANKS)), "[ \\t\\n\\f\\r]+"), found)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page by a total order; the number is at least 1, the size from 1 to 50."""
    number, size = max(1, number), min(50, max(1, size))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def envelope(rows: DataFrame, number: int, size: int) -> DataFrame:
    """total_docs, page, size, total_pages, has_next, has_prev."""
    number, size = max(1, number), min(50, max(1, size))
    total = rows.agg(F.count(F.lit(1)).alias("total_docs"))
    pages = F.ceil(F.col("total_docs") / size)
    return total.select("total_docs", F.lit(number).alias("page"), F.lit(size).alias("size"), pages.alias("total_pages"), (pages > number).alias("has_next"), F.lit(number > 1).alias("has_prev"))


def global_search(sources: dict[str, tuple[DataFrame, str, list[str]]], words: str, most: int = 3) -> DataFrame:
    """type, id, title of at most `most` hits of each source (frame, id column, columns searched, the first as title), by title and id.

    A source whose columns are not there finds nothing, and the others are searched all the same.
    """
    parts = []
    for name, (frame, key, columns) in sources.items():
        if {key, *columns} <= set(frame.columns):
            parts.append(frame.where(has_all_words(columns, words)).select(F.lit(name).alias("type"), F.col(key).cast("long").alias("id"), F.col(columns[0]).alias("title")))
    every = reduce(lambda a, b: a.unionByName(b), parts)
    order = Window.partitionBy("type").orderBy("title", "id")
    return every.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")


def similar_names(rows: DataFrame, column: str, query: str, key: str, least: float = 0.3, most: int = 20) -> DataFrame:
    """key, name and similarity by trigrams, folded to ASCII; best first."""
    scored = rows.select(key, F.col(column).alias("name"), F.round(jaccard(trigrams(F.col(column)), trigrams(F.lit(query))), 6).alias("similarity"))
    return scored.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), key).limit(most)


def responsible(located_points: DataFrame, courts: DataFrame, key: str, area: str, columns: list[str]) -> DataFrame:
    """What a click on the map shows: key, the polygon's number and the given columns of the court that names it in `area`;
    of several courts the first by these columns, none where no court does."""
    named = courts.where(F.col(area).isNotNull()).groupBy(F.col(area).alias("ord")).agg(F.min(F.struct(*columns)).alias("court"))
    return located_points.join(named, "ord", "left").select(key, "ord", *(F.col(f"court.{c}").alias(c) for c in columns))


def similar_pairs(asked: DataFrame, rows: DataFrame, column: str, key: str, least: float = 0.3) -> DataFrame:
    """asked_key, key and similarity of all pairs of a name asked for and a name of the table that are at least so similar
    by trigrams: a set-similarity join. Names without trigrams are like none.

    Names are compared once however many rows have them. Two sets that similar share one of the rarest
    n - ceil(least * n) + 1 grams of each, and their sizes differ by no more than that factor; so only names that meet on
    such a gram are compared. Grams are ranked by how many names have them. The rows of similar names are paired by blocks
    of about BLOCK rows, dealt evenly, so a frequent name goes to as many tasks as its pairs need.
    """

    def names(frame: DataFrame, name: str) -> DataFrame:
        each = frame.groupBy(F.col(column).alias(name)).agg(F.count(F.lit(1)).alias(f"rows_{name}"))
        return each.withColumn("grams", trigrams(F.col(name))).where(F.size("grams") > 0)

    known, wanted = names(rows, "name"), names(asked, "asked_name")
    rarity = known.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))

    def prefixes(frame: DataFrame, name: str) -> DataFrame:
        each = frame.select(name, F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(rarity, "gram", "left")
        # A name's grams are one group: as many as it has letters.
        own = each.groupBy(name, "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("g"))
        kept = (F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1).cast("int")
        return own.select(name, F.col("n").alias(f"n_{name}"), F.explode(F.slice("g", F.lit(1), kept)).alias("g")).select(name, f"n_{name}", "g.gram")

    fit = (F.col("n_name") >= F.col("n_asked_name") * least - 1e-9) & (F.col("n_asked_name") >= F.col("n_name") * least - 1e-9)
    pairs = prefixes(wanted, "asked_name").join(prefixes(known, "name"), "gram").where(fit).select("asked_name", "name").distinct()
    both = pairs.join(wanted.select("asked_name", F.col("grams").alias("a")), "asked_name").join(known.select("name", F.col("grams").alias("b")), "name")
    similar = both.select("asked_name", "name", F.round(jaccard(F.col("a"), F.col("b")), 6).alias("similarity")).where(F.col("similarity") >= least)

    def blocks(frame: DataFrame, sizes: DataFrame, name: str, keys: str) -> DataFrame:
        slot = F.pmod(F.xxhash64("k"), F.ceil(F.col(f"rows_{name}") / BLOCK))
        # In structs, as collect_list leaves out nulls.
        own = frame.select(F.col(column).alias(name), F.col(key).alias("k")).join(sizes.select(name, f"rows_{name}"), name)
        return own.groupBy(name, slot.alias("slot")).agg(F.collect_list(F.struct("k")).alias(keys)).drop("slot")

    met = blocks(asked, wanted, "asked_name", "askers").join(similar, "asked_name").join(blocks(rows, known, "name", "keys"), "name")
    dealt = met.select("askers", "keys", "similarity").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = dealt.select("similarity", "keys", F.explode("askers").alias("asker")).select("asker", F.explode("keys").alias("one"), "similarity")
    return each.select(F.col("asker.k").alias("asked_key"), F.col("one.k").alias("key"), "similarity")


def visible(rows: DataFrame, role: str | None, published: str, now: str) -> DataFrame:
    """Editors and admins see all rows, others those published by now."""
    return rows if role in ("admin", "editor") else rows.where(F.col(published).isNotNull() & (F.col(published) <= F.to_timestamp_ntz(F.lit(now))))


def own_or_admin(users: DataFrame, role: str | None, user_id: object, key: str = "id") -> DataFrame:
    return users if role == "admin" else users.where(F.col(key) == F.lit(user_id))


def masked(rows: DataFrame, columns: list[str], *, member: bool) -> DataFrame:
    """Columns that only members see are null for others."""
    return rows if member else rows.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in columns})


def granted_role(change: Column, role: Column, by_admin: Column) -> Column:
    """What a write may set: admins anything; others member on create and nothing on update."""
    return F.when(by_admin, role).when(change == "create", F.lit("member"))


def contact_errors(name: Column, email: Column, subject: Column, message: Column) -> Column:
    """Names of the fields that are wrong."""
    filled = lambda c: F.coalesce(F.trim(c), F.lit(""))
    checks = {"name": filled(name) == "", "email": ~F.coalesce(email, F.lit("")).rlike("^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$"), "subject": ~F.coalesce(subject, F.lit("")).isin(SUBJECTS), "message": F.length(filled(message)) < 20}
    return F.array_compact(F.array(*(F.when(wrong, field) for field, wrong in checks.items())))


def contact_outcome(trap: Column, errors: Column) -> Column:
    """What a form does: a filled trap field, which people don't see, is answered as if sent but dropped; errors are told."""
    return F.when(F.length(F.coalesce(trap, F.lit(""))) > 0, "dropped").when(F.size(errors) > 0, "rejected").otherwise("sent")


def question_ok(question: Column, k: Column) -> Column:
    return F.length(F.trim(question)).between(3, 2000) & k.between(1, 20)


def in_country(lat: Column, lng: Column) -> Column:
    return lat.between(*LATITUDE) & lng.between(*LONGITUDE)


def edges(features: DataFrame, order: str, kind: str = "kind", coordinates: str = "coordinates") -> DataFrame:
    """order and x1, y1, x2, y2 of the outer rings of features; coordinates: polygons of rings of points (a Polygon is one polygon)."""
    rings = features.select(order, F.posexplode(F.transform(coordinates, lambda polygon: F.get(polygon, 0))).alias("polygon", "ring"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("ring") - 1), lambda i: F.struct(F.get("ring", i).alias("a"), F.get("ring", (i + F.size("ring") - 1) % F.size("ring")).alias("b")))
    each = rings.where(F.size("ring") > 0).select(order, "polygon", F.explode(pairs).alias("e"))
    return each.select(order, "polygon", F.col("e.a")[0].alias("xi"), F.col("e.a")[1].alias("yi"), F.col("e.b")[0].alias("xj"), F.col("e.b")[1].alias("yj"))


def located(points: DataFrame, features: DataFrame, key: str, x: str, y: str, order: str = "ord", cells: int = 1024) -> DataFrame:
    """key and the first feature, by order, whose outer ring holds the point; points in none are left out.

    The y range of all rings is cut into `cells` bands. A ring's edge stands in each band that it touches, a point in its
    own; they meet by band and by the ring's box, so a point meets the edges of its band, not all. Both sides may be of
    any size. Crossings of each point and ring are counted before the shuffle.
    """
    table = edges(features, order)
    ends = table.agg(F.min(F.least("yi", "yj")).alias("lo"), F.max(F.greatest("yi", "yj")).alias("hi")).first()
    if ends["lo"] is None:
        return points.select(key).limit(0).withColumn(order, F.lit(None).cast(features.schema[order].dataType))
    low, height = ends["lo"], max(ends["hi"] - ends["lo"], 1e-9) / cells
    band = lambda c: F.floor((c - low) / height)
    ring = Window.partitionBy(order, "polygon")
    reach = {"west": F.min(F.least("xi", "xj")).over(ring), "east": F.max(F.greatest("xi", "xj")).over(ring)}
    banded = table.withColumns(reach).withColumn("band", F.explode(F.sequence(band(F.least("yi", "yj")), band(F.greatest("yi", "yj")))))
    crosses = (F.col("yi") > F.col(y)) != (F.col("yj") > F.col(y))
    left_of = F.col(x) < (F.col("xj") - F.col("xi")) * (F.col(y) - F.col("yi")) / F.when(F.col("yj") != F.col("yi"), F.col("yj") - F.col("yi")) + F.col("xi")
    hit = points.select(key, x, y, band(F.col(y)).alias("band")).join(banded, "band").where(F.col(x).between(F.col("west"), F.col("east")) & crosses & left_of)
    inside = hit.groupBy(key, order, "polygon").agg((F.count(F.lit(1)) % 2).alias("odd")).where("odd = 1")
    return inside.groupBy(key).agg(F.min(order).alias(order))


def by_id_or_slug(rows: DataFrame, courts: DataFrame, court_id: str = "court_id", slug: str = "court_slug") -> DataFrame:
    """Adds the court's name: by id where there is one (even if it misses), else by slug, else null."""
    by_id = courts.select(F.col("id").alias(court_id), F.col("name").alias("_by_id")).dropDuplicates([court_id])
    by_slug = courts.select(F.col("slug").alias(slug), F.col("name").alias("_by_slug")).dropDuplicates([slug])
    joined = rows.join(by_id, court_id, "left").join(by_slug, slug, "left")
    return joined.withColumn("court_name", F.when(F.col(court_id).isNotNull(), F.col("_by_id")).otherwise(F.col("_by_slug"))).drop("_by_id", "_by_slug")


def populated(rows: DataFrame, others: DataFrame, key: str, array: str, other_key: str, name: str) -> DataFrame:
    """key and names: the others that an array of keys names, in the array's order; missing ones are skipped."""
    each = rows.select(key, F.posexplode_outer(array).alias("pos", other_key))
    joined = each.join(others.select(other_key, name), other_key, "left").where(F.col(name).isNotNull())
    return rows.select(key).join(joined.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", name))).alias("_n")), key, "left").select(key, F.coalesce(F.transform("_n", lambda x: x[name]), F.array().cast("array<string>")).alias("names"))


def feed_items(rows: DataFrame, title: str, text: str, date: str, key: str, link: str, most: int = 50) -> DataFrame:
    """key and item: the XML of the latest rows."""
    latest = rows.orderBy(F.desc(date), F.desc(key)).limit(most)
    address = F.concat(F.lit(link), F.col(key).cast("string"))
    item = F.concat(
        F.lit("<item><title>"), xml_escaped(F.col(title)), F.lit("</title><link>"), address, F.lit("</link><description>"), xml_escaped(plain(F.col(text))), F.lit("</description><pubDate>"), rfc2822(F.col(date)), F.lit("</pubDate></item>"),
    )
    return latest.select(key, item.alias("item"))


def search_text(*columns: Column, tags: Column | None = None) -> Column:
    """What is searched: columns and tags in lower case."""
    return F.lower(F.concat_ws(" ", *columns, *([tags] if tags is not None else [])))
