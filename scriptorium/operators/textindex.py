"""A stored positional index of texts: found by all words, by phrase or by BM25, with accents or without.

Postings lie in folders by segment and by the hash of the term without accents, and are sorted by term within a folder:
a search reads the folders of its own terms, and in them the row groups of its terms. A batch of new or changed documents
becomes a segment of its own; no other segment's files are touched. What a batch replaces is noted as gone, with what
it counted towards its terms, so that counts are those of the documents as they are. `compact` writes all live documents
as one segment of another index.

A segment counts from when its row of totals is written, which comes last; a batch that failed before is repeated and
replaces what it left. One process writes at a time.

A null text has no tokens; rows without an id are not taken; of rows of a batch that share an id, the one whose text has
the larger hash is. Positions count tokens, stop words and single characters left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_list
from ..sources.scratch import discard, written
from .retrieval import EPSILON, LexicalIndex

BUCKETS = 64
# Letters of tokens with an accent, and without.
ACCENTED, PLAIN = "čćđšžáéíóú", "ccdszaeiou"
#: Rows of a batch that are sent to every task; more are joined by a shuffle.
FEW = 100_000


def plain_term(term: Column) -> Column:
    return F.translate(term, ACCENTED, PLAIN)


def tokens_of(query: str, spark: SparkSession) -> list[str]:
    """The tokens of one query."""
    return spark.range(1).select(token_list(F.lit(query)).alias("t")).first()["t"]


#: The tables of an index; of ids the type is the index's own.
SCHEMAS = {
    "postings": "plain string, term string, id {id}, dl bigint, at array<int>, tf bigint, segment int, bucket int",
    "lengths": "id {id}, dl bigint, terms array<string>, segment int",
    "terms": "term string, df bigint, segment int",
    "gone": "id {id}, upto int, segment int",
    "totals": "documents bigint, tokens bigint, mean_weight double, segment int",
}


@dataclass
class TextIndex:
    spark: SparkSession
    path: str
    buckets: int = BUCKETS
    id_type: str = "bigint"

    # Tables

    def _table(self, name: str) -> DataFrame:
        schema = SCHEMAS[name].format(id=self.id_type)
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as error:  # noqa: BLE001  not written yet
            if "PATH_NOT_FOUND" in str(error):
                return self.spark.createDataFrame([], schema)
            raise

    def totals(self) -> list[dict]:
        """A row for each segment, in order: segment, documents and tokens of the whole index after it, mean of its terms' weights."""
        return sorted((r.asDict() for r in self._table("totals").collect()), key=lambda r: r["segment"])

    def _committed(self, name: str, segments: int | None = None) -> DataFrame:
        n = len(self.totals()) if segments is None else segments
        return self._table(name).where(F.col("segment") < n)

    def _live(self, rows: DataFrame, segments: int) -> DataFrame:
        """Without what later segments have replaced. What is gone is as much as was changed since the last compact()."""
        if segments < 2:
            return rows
        last = self._table("gone").where(F.col("segment") < segments).groupBy("id").agg(F.max("upto").alias("upto"))
        last = F.broadcast(last) if last.limit(FEW + 1).count() <= FEW else last
        return rows.join(last, "id", "left").where("upto is null or upto < segment").drop("upto")

    def lengths(self) -> DataFrame:
        """id and dl of each document."""
        n = len(self.totals())
        return self._live(self._committed("lengths", n), n).select("id", "dl")

    def bucket(self, plain: Column) -> Column:
        return F.pmod(F.xxhash64(plain), F.lit(self.buckets)).cast("int")

    # Writing

    def _write(self, rows: DataFrame, name: str, segment: int, by: list[str]) -> None:
        out = rows.withColumn("segment", F.lit(segment))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment", *by).parquet(f"{self.path}/{name}")

    def _put_postings(self, rows: DataFrame, segment: int) -> None:
        """By ranges of bucket, term and id: a frequent term goes to as many tasks as it needs, and files hold few terms."""
        self._write(rows.sortWithinPartitions("bucket", "plain", "term", "id"), "postings", segment, ["bucket"])

    def add(self, documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> int:
        """Takes new documents in, and changed ones in place of the old; the segment's number."""
        cut = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast(self.id_type).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        if cut.groupBy("id").count().where("count > 1").limit(1).count():
            cut = cut.groupBy("id").agg(F.max_by("text", F.xxhash64("text")).alias("text"))
        tokens = written(cut.select("id", token_list(F.col("text")).alias("tokens")).withColumn("dl", F.size("tokens").cast("long")), "tokens")
        return self._segment(tokens)

    def remove(self, ids: DataFrame, doc_id: str = "id") -> int:
        """Documents of these ids are gone from now on."""
        empty = ids.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast(self.id_type).alias("id")).distinct()
        none = written(empty.select("id", F.array().cast("array<string>").alias("tokens"), F.lit(0).cast("long").alias("dl")), "tokens")
        return self._segment(none, keep=False)

    def _segment(self, tokens: DataFrame, *, keep: bool = True) -> int:
        segment = len(self.totals())
        each = tokens.select("id", "dl", F.posexplode("tokens").alias("at", "term")).withColumn("plain", plain_term(F.col("term")))
        dealt = each.withColumn("bucket", self.bucket(F.col("plain"))).repartitionByRange("bucket", "plain", "term", "id")
        grouped = dealt.groupBy("bucket", "plain", "term", "id", "dl").agg(F.sort_array(F.collect_list("at")).alias("at"))
        self._put_postings(grouped.withColumn("tf", F.size("at").cast("long")), segment)
        known = tokens if keep else tokens.limit(0)
        self._write(known.select("id", "dl", F.array_distinct("tokens").alias("terms")), "lengths", segment, [])
        counts = known.select(F.explode(F.array_distinct("tokens")).alias("term"), F.lit(1).alias("n"))
        if segment:
            ids = tokens.select("id")
            ids = F.broadcast(ids) if ids.limit(FEW + 1).count() <= FEW else ids
            replaced = written(self._live(self._committed("lengths", segment), segment).join(ids, "id", "left_semi").select("id", "terms"), "replaced")
            self._write(replaced.select("id", F.lit(segment - 1).alias("upto")), "gone", segment, [])
            counts = counts.unionByName(replaced.select(F.explode("terms").alias("term"), F.lit(-1).alias("n")))
        self._write(counts.groupBy("term").agg(F.sum("n").alias("df")), "terms", segment, [])
        self._finish(segment)
        discard(tokens, *([replaced] if segment else []))
        return segment

    def _finish(self, segment: int) -> None:
        n = segment + 1
        facts = self._live(self._committed("lengths", n), n).agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens"))
        mean = self._raw(self._counts(n), facts.first()["documents"]).agg(F.avg("raw").alias("mean_weight"))
        self._write(facts.join(F.broadcast(mean)), "totals", segment, [])  # one row each

    def compact(self, path: str) -> TextIndex:
        """All live documents as the only segment of an index at another path."""
        other, n = TextIndex(self.spark, path, self.buckets, self.id_type), len(self.totals())
        live = self._live(self._committed("postings", n), n).drop("segment").repartitionByRange("bucket", "plain", "term", "id")
        other._put_postings(live, 0)
        other._write(self._live(self._committed("lengths", n), n).drop("segment"), "lengths", 0, [])
        other._write(self._counts(n), "terms", 0, [])
        other._finish(0)
        return other

    # Searching

    def _counts(self, segments: int) -> DataFrame:
        """term and df, of terms that a live document has."""
        return self._committed("terms", segments).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    @staticmethod
    def _raw(counts: DataFrame, documents: int) -> DataFrame:
        return counts.withColumn("raw", F.round(F.ln(documents - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5), 12))

    def postings(self, plain: list[str]) -> DataFrame:
        """The live postings of terms that are these without accents. Only their folders are listed and read."""
        n = len(self.totals())
        own = sorted({r["b"] for r in self.spark.createDataFrame([(p,) for p in plain], "p string").select(self.bucket(F.col("p")).alias("b")).collect()})
        return self._live(self._committed("postings", n).where(F.col("bucket").isin(own) & F.col("plain").isin(plain)), n)

    def search(self, query: str) -> DataFrame:
        """id and rank of the documents that have every token of the query, accents aside: the share of their tokens that
        are the query's, 6 digits. A query without tokens finds nothing."""
        wanted = sorted({t.translate(str.maketrans(ACCENTED, PLAIN)) for t in tokens_of(query, self.spark)})
        if not wanted:
            return self.lengths().limit(0).select("id", F.lit(0.0).alias("rank"))
        hits = self.postings(wanted).groupBy("id", "dl").agg(F.count_distinct("plain").alias("n"), F.sum("tf").alias("tf"))
        return hits.where(F.col("n") == len(wanted)).select("id", F.round(F.col("tf") / F.col("dl"), 6).alias("rank"))

    def phrase(self, query: str) -> DataFrame:
        """id and places (positions of the first token, ascending) of the documents in which the query's tokens stand
        consecutively, accents aside."""
        wanted = [t.translate(str.maketrans(ACCENTED, PLAIN)) for t in tokens_of(query, self.spark)]
        if not wanted:
            return self.lengths().limit(0).select("id", F.array().cast("array<int>").alias("places"))
        table = F.create_map(*(x for t in dict.fromkeys(wanted) for x in (F.lit(t), F.array(*(F.lit(k) for k, w in enumerate(wanted) if w == t)))))
        # A row for each of the phrase's places that a document's term can stand at: at most as many as the phrase has tokens, and spellings.
        each = self.postings(sorted(set(wanted))).select("id", F.explode(table[F.col("plain")]).alias("k"), "at")
        starts = each.select("id", "k", F.transform("at", lambda p: p - F.col("k")).alias("starts"))
        spelt = starts.groupBy("id", "k").agg(F.flatten(F.collect_list("starts")).alias("starts"))
        all_ = spelt.groupBy("id").agg(F.collect_list("starts").alias("s")).where(F.size("s") == len(wanted))
        common = F.aggregate(F.slice("s", 2, len(wanted)), F.col("s")[0], F.array_intersect) if len(wanted) > 1 else F.col("s")[0]
        return all_.select("id", F.sort_array(F.array_distinct(common)).alias("places")).where(F.size("places") > 0)

    def lexical(self) -> LexicalIndex:
        """What retrieval.bm25 reads: terms as they are spelt, with their weights, over the postings' folders."""
        totals = self.totals()
        n, last = len(totals), totals[-1]
        weight = F.when(F.col("raw") < 0, F.lit(EPSILON * (last["mean_weight"] or 0.0))).otherwise(F.col("raw"))
        terms = self._raw(self._counts(n), last["documents"]).select("term", "df", weight.alias("idf"))
        postings = self._live(self._committed("postings", n), n).select("term", "id", "tf", "dl", "bucket")
        return LexicalIndex(self.lengths(), terms, postings=postings, bucket=lambda term: self.bucket(plain_term(term)))


#: Indexes of this process, by what they are of: those that queries share.
_KEPT: dict[tuple, TextIndex] = {}


def kept(documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> TextIndex:
    """The index of a table of files, built when it is first asked for and read from then on; built anew where the files
    are others than they were. It lies under `path`, the shared folder."""
    spark = documents.sparkSession
    files = documents.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    name = files.agg(F.hex(F.bit_xor(F.xxhash64("*"))).alias("h"), F.count(F.lit(1)).alias("n")).first()
    key = (spark.sparkContext.applicationId, path, name["h"], name["n"])
    if key not in _KEPT:
        index = TextIndex(spark, f"{path}/index-{name['h']}-{name['n']}-{spark.sparkContext.applicationId}")
        if not index.totals():
            index.add(documents, doc_id, text)
        _KEPT[key] = index
    return _KEPT[key]
