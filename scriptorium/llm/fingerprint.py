"""Document fingerprints by consistent weighted sampling.

A text is a bag of words, weighted by how often each occurs. For sample k each word has, from hashes of the word and k
alone, r and c from the gamma distribution with shape 2 and b, uniform. With t = floor(ln(weight) / r + b), the word
with the smallest ln(c) - r * (t - b + 1) is the sample, together with t. Two texts agree on a sample with a chance
equal to their generalised Jaccard similarity, sum(min weights) / sum(max weights); the share of samples that agree
estimates it, with a standard error of 0.0625 at most with SAMPLES = 64. Everything is DataFrame functions.

Rows are dealt over ranges of doc_id that hold about as many rows each, so that a row and the next one meet in one
sorted range; only the first row of each range is sent to the range before it.

A null text counts as empty; an empty text has one pseudo-word of its own, so empty texts equal each other and nothing
else. Rows that repeat a doc_id are ordered by text and each get a result. The row after the last is the first; a lone
row follows itself. Rows without doc_id have no place in the order: they get a fingerprint of their text, and nulls for
all that needs a next document. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text, words, written

SAMPLES, STEP = 64, 8
#: Ranges of doc_id, per shuffle partition.
RANGES = 4


def _gamma(a: Column, b: Column) -> Column:
    """A draw with shape 2 and scale 1, from two uniform ones."""
    return -F.ln(a * b)


def _uniform(h: Column, shift: int, bits: int) -> Column:
    """A number between 0 and 1, exclusive, from some bits of a 64-bit hash."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + 0.5) * (1.0 / (1 << bits))


def _sample(term: Column, k: Column) -> tuple[Column, Column, Column]:
    """r, ln(c) and b of a word for sample k: 24, 28 and 12 bits of one hash, enough for draws that only have to order the words of a text."""
    h = F.xxhash64(term, k)
    r = _gamma(_uniform(h, 0, 12), _uniform(h, 12, 12))
    c = F.ln(_gamma(_uniform(h, 24, 14), _uniform(h, 38, 14)))
    return r, c, _uniform(h, 52, 12)


def _candidate(term: Column, log_weight: Column, r: Column, c: Column, b: Column) -> Column:
    """ln(a) in the upper 32 bits, so that the smallest number has it; the word's hash, moved by t, in the lower.

    Null for a word of no weight, whose logarithm is null: no condition, so that both sides share r, c and b. ln(a) lies
    between -80 and 4: r is below 19, ln(c) between -10 and 4, and no weight has a logarithm above 21.
    """
    t = F.floor(log_weight / r + b)
    log_a = c - r * (t - b + 1)
    own = term.bitwiseXOR(F.shiftleft(t, 16)).bitwiseAND(F.lit((1 << 32) - 1))
    return F.shiftleft(((log_a + 128.0) * float(1 << 23)).cast("long"), 32).bitwiseOR(own)


def in_ranges(documents: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, int]:
    """The rows that have an id, with `part`, the number of their range of ids; and how many ranges there are at most.

    The ranges end at quantiles of the ids. What is collected is one id a range, whatever the input.
    """
    spark = documents.sparkSession
    parts = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("i"))
    ends = ids.agg(F.percentile_approx("i", [k / parts for k in range(1, parts)], 20 * parts)).first()[0] or []
    ends = sorted(set(ends))
    if not ends:
        return documents.where(F.col(doc_id).isNotNull()).withColumn("part", F.lit(0)), 1
    bounds = F.lit(ends)
    # How many ends lie below the id, by halving what is left of them.
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(ends)).alias("hi"))

    def halved(state: Column, _: Column) -> Column:
        middle = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        open_, below = state["lo"] < state["hi"], F.get(bounds, middle) < F.col(doc_id)
        return F.struct(F.when(open_ & below, middle + 1).otherwise(state["lo"]).alias("lo"), F.when(open_ & ~below, middle).otherwise(state["hi"]).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(len(ends).bit_length() + 1))
    return documents.where(F.col(doc_id).isNotNull()).withColumn("part", F.aggregate(steps, start, halved)["lo"]), parts


def with_next(frame: DataFrame, columns: list[str], order: list[str], heads: DataFrame | None = None) -> DataFrame:
    """Adds next_<column> of the row that follows by `order` (part first); after the last row comes the first.

    The window runs within each part. The first row of each part is taken to the part before: `heads`, a frame of one
    row a part (part and the columns).
    """
    inside = Window.partitionBy("part").orderBy(*order)
    spots = frame.withColumns({"_last": F.lead(F.lit(1)).over(inside).isNull(), **{f"next_{c}": F.lead(c).over(inside) for c in columns}})
    if heads is None:
        heads = frame.withColumn("_n", F.row_number().over(inside)).where("_n = 1")
    heads = heads.select("part", *(F.col(c).alias(f"_head_{c}") for c in columns))
    # One row a part, so this unpartitioned window has a bounded size.
    chain = Window.orderBy("part")
    first = F.first("part").over(chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    follows = heads.select("part").select("part", F.coalesce(F.lead("part").over(chain), first).alias("_follows"))
    heads = follows.join(heads.withColumnRenamed("part", "_follows"), "_follows").drop("_follows")
    joined = spots.join(heads, "part", "left")
    return joined.withColumns({f"next_{c}": F.when(F.col("_last"), F.col(f"_head_{c}")).otherwise(F.col(f"next_{c}")) for c in columns}).drop("_last", *(f"_head_{c}" for c in columns))


def signatures(frame: DataFrame, key: list[str], texts: dict[str, str], samples: int = SAMPLES) -> DataFrame:
    """key and, for each name in texts (name to column of text), an array of `samples` ints; nulls for a null text.

    Words that the texts of a row share are hashed once. Rows must be unique by key and dealt by a part of it.
    """
    names = list(texts)
    sides = F.array(*(F.col(c) for c in texts.values()))
    each = frame.select(*key, F.posexplode(sides).alias("_side", "_text")).select(*key, "_side", F.explode(words(F.col("_text"))).alias("_word"))
    each = each.select(*key, "_side", F.xxhash64("_word").alias("_term"))
    counted = each.groupBy(*key, "_term").agg(*(F.sum(F.when(F.col("_side") == i, 1).otherwise(0)).alias(f"_w{i}") for i in range(len(names))))
    counted = counted.withColumns({f"_l{i}": F.ln(F.col(f"_w{i}").cast("double")) for i in range(len(names))})
    # Some samples at a time, each time as rows of their own: code for all of them would be too long to be compiled.
    step = min(STEP, samples)
    counted = counted.withColumn("_from", F.explode(F.sequence(F.lit(0), F.lit(samples - 1), F.lit(step))))
    least = []
    for k in range(step):
        r, c, b = _sample(F.col("_term"), F.col("_from") + k)
        least += [F.min(_candidate(F.col("_term"), F.col(f"_l{i}"), r, c, b)).alias(f"_m{i}_{k}") for i in range(len(names))]
    low = lambda c: (F.col(c).bitwiseAND(F.lit((1 << 32) - 1)) - (1 << 31)).cast("int")
    some = counted.groupBy(*key, "_from").agg(*least)
    some = some.select(*key, F.struct("_from", *(F.array(*(low(f"_m{i}_{k}") for k in range(step))).alias(name) for i, name in enumerate(names))).alias("_some"))
    every = some.groupBy(*key).agg(F.array_sort(F.collect_list("_some")).alias("_some"))
    return every.select(*key, *(F.slice(F.flatten(F.col(f"_some.{name}")), 1, samples).alias(name) for name in names))


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x.cast("long") + (1 << 31)), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of samples that agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def with_edited(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """part, doc_id, nth (among rows of that id), text, n_chars and edited: the second half replaced by as much of the next row's start.

    Rows without doc_id stand in parts of their own, numbered below zero and dealt by text, and have no edited text.
    """
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    ranged, parts = in_ranges(rows)
    # Of each range the text of its first row, looked up by id: not taken from all texts, once more shuffled.
    firsts = ranged.groupBy("part").agg(F.min("doc_id").alias("doc_id"))
    heads = ranged.join(F.broadcast(firsts), ["part", "doc_id"]).groupBy("part").agg(F.min("text").alias("text"))
    ranged = ranged.repartition(parts, "part")
    ranged = ranged.withColumn("nth", F.row_number().over(Window.partitionBy("part", "doc_id").orderBy("text")))
    followed = with_next(ranged, ["text"], ["doc_id", "nth"], heads)
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    placed = followed.select("part", "doc_id", "nth", "text", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    lone = rows.where("doc_id is null").withColumn("part", (-1 - F.pmod(F.xxhash64("text"), F.lit(parts))).cast("int"))
    lone = lone.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("text")))
    return placed.unionByName(lone.select("part", "doc_id", "nth", "text", n.cast("long").alias("n_chars"), F.lit(None).cast("string").alias("edited")))


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, own and changed (signatures of the text and the edited text) and next_own, that of the next row."""
    key = ["part", "doc_id", "nth"]
    rows = with_edited(documents, doc_id, text)
    # A table, so that signatures are made once, however often the steps below look at them.
    signed = written(signatures(rows, key, {"own": "text", "changed": "edited"}, samples), "fingerprints")
    facts = rows.select(*key, "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    there = with_next(signed.where("part >= 0"), ["own"], ["doc_id", "nth"]).unionByName(signed.where("part < 0").withColumn("next_own", F.lit(None).cast("array<int>")))
    same = (facts["part"] == there["part"]) & facts["doc_id"].eqNullSafe(there["doc_id"]) & (facts["nth"] == there["nth"])
    changed = F.when(F.col("edited_sha256").isNotNull(), F.col("changed")).alias("changed")
    return facts.join(there, same).select(facts["doc_id"], "n_chars", "edited_sha256", "own", changed, "next_own")
