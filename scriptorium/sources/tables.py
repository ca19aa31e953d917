"""Sources and sinks: JSON lines, parquet and JDBC tables, GeoJSON, HTML, links, PDFs and images through injected readers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RAW_DOCUMENT = "source string, source_id string, title string, text string, lang string, metadata map<string,string>"
CHUNK = (
    "chunk_id string, source_id string, kind string, title string, text string, url string, author string, case_number string, article_number string, date string, year int"
)
SOURCE_CHUNK = "source_id string, source_type string, source string, title string, url string, author string, year int, chunk_index long, chunk_count long, article_number string, text string"

# Parts of a page that are no content, and where its content is looked for, first match wins.
SKIPPED = {"script", "style", "noscript", "nav", "aside", "header", "footer", "form"}
CONTENT = [("div", "class", "clanak-txt"), ("main", None, None), ("body", None, None)]
LAW_CONTENT = [("div", "id", "TexteOnly"), ("main", None, None), ("body", None, None)]
OCR_CHARS_A_PAGE = 100
VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}


def json_lines(spark: SparkSession, paths: list[str], schema: str, *, strict: bool = True) -> DataFrame:
    """Blank lines are skipped; a malformed line is an error, or is dropped if not strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(paths)


def ranked_files(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Rows with file_rank (the place of their path or glob in the list, from 1), file, block and line: in this order the
    rows stand as in the files, one after the other; what first-wins rules order by.

    A file's blocks are read in one piece each, so `line`, which grows as a task reads, orders the rows of a block.
    """
    parts = []
    for rank, path in enumerate(paths, 1):
        rows = json_lines(spark, [path], schema, strict=False)
        order = {"file_rank": F.lit(rank), "file": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start"), "line": F.monotonically_increasing_id()}
        parts.append(rows.withColumns(order))
    return reduce(lambda a, b: a.unionByName(b), parts)


#: What orders the rows of ranked_files().
FILE_ORDER = ["file_rank", "file", "block", "line"]


def of_sources(rows: DataFrame, only: list[str] | None) -> DataFrame:
    return rows.where(F.col("source").isin(only)) if only else rows


def jdbc_table(spark: SparkSession, options: dict[str, str], table: str) -> DataFrame:
    """A database table; url, user and the like come from the options alone."""
    return spark.read.format("jdbc").options(**options).option("dbtable", table).load()


def long_texts(rows: DataFrame, text: str, least: int = 400) -> DataFrame:
    return rows.where(F.col(text).isNotNull() & (F.length(text) >= least))


def append_lines(frame: DataFrame, path: str) -> int:
    """Appends the rows as JSON lines; how many there were, counted as they are written."""
    seen = Observation()
    frame.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").json(path)
    return seen.get["n"]


def replace_lines(frame: DataFrame, path: str) -> int:
    """Replaces what is there by the rows as JSON lines; how many there were, counted as they are written."""
    seen = Observation()
    frame.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def save_evaluation(rows: DataFrame, summary: DataFrame, path: str, **settings: object) -> int:
    """The evaluated rows as JSON lines under `rows`, their one-row summary with the run's settings under `summary`; how many rows."""
    count = replace_lines(rows, f"{path}/rows")
    summary.withColumns({name: F.lit(value) for name, value in settings.items()}).coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    return count


def features(spark: SparkSession, path: str) -> DataFrame:
    """ord (from 0, in file order), name, court_id, court_slug and coordinates (polygons of rings of points) of a GeoJSON file."""
    properties = "properties struct<jurisdictionName:string,courtId:string,courtSlug:string>"
    schema = f"features array<struct<{properties.replace('properties ', 'properties:')},geometry:struct<type:string,coordinates:string>>>"
    each = spark.read.option("multiLine", True).schema(schema).json(path).select(F.posexplode("features").alias("ord", "f"))
    polygon = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    several = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    coordinates = F.when(F.col("f.geometry.type") == "Polygon", F.array(polygon)).when(F.col("f.geometry.type") == "MultiPolygon", several)
    return each.select("ord", F.col("f.properties.jurisdictionName").alias("name"), F.col("f.properties.courtId").alias("court_id"), F.col("f.properties.courtSlug").alias("court_slug"), coordinates.alias("coordinates"))


class _Page(HTMLParser):
    """Gathers the texts inside each wanted element, without those of skipped ones."""

    def __init__(self, wanted: list[tuple[str, str | None, str | None]]):
        super().__init__(convert_charrefs=True)
        self.wanted, self.found = wanted, [[] for _ in wanted]
        self.open: list[tuple[str, list[int], bool]] = []
        self.seen = [False] * len(wanted)

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        attrs = dict(attrs)
        hits = []
        for i, (name, attr, value) in enumerate(self.wanted):
            if tag == name and not self.seen[i] and (attr is None or value in (attrs.get(attr) or "").split()):
                self.seen[i] = True
                hits.append(i)
        self.open.append((tag, hits, tag in SKIPPED))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        if data.strip() and not any(skip for _, _, skip in self.open):
            for _, hits, _ in self.open:
                for i in hits:
                    self.found[i].append(data.strip())


def page_text(html: str, wanted: list[tuple[str, str | None, str | None]] = CONTENT) -> str:
    """The stripped texts of the first wanted element that is there, one a line."""
    page = _Page(wanted)
    page.feed(html)
    page.close()
    return next(("\n".join(texts) for texts, seen in zip(page.found, page.seen, strict=True) if seen), "")


def html_text(html: Column, wanted: list[tuple[str, str | None, str | None]] | None = None) -> Column:
    chosen = wanted or CONTENT

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda h: "" if h is None else page_text(h, chosen))

    return extract(html)


def html_title(html: Column) -> Column:
    """The page's <title>, collapsed."""
    return F.trim(F.regexp_replace(F.regexp_extract(F.coalesce(html, F.lit("")), "(?is)<title[^>]*>([^<]*)", 1), "\\s+", " "))


def links(pages: DataFrame, key: str, html: str, pattern: str = 'href="([^"]+)"') -> DataFrame:
    """key and href: distinct links of each page."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(pattern), F.lit(1)))
    return pages.select(key, F.explode(found).alias("href"))


def url_id(url: Column, n: int = 16) -> Column:
    return F.substring(F.sha1(url), 1, n)


def pdf_texts(spark: SparkSession, path: str, read: Callable[[bytes], Iterable[str | None | Callable[[], str | None]]]) -> DataFrame:
    """path, text and pages of PDF files through an injected reader, which gives a file's pages: texts, or functions that
    read one. A page that can't be read is empty; a file that can't be opened has no pages."""

    @F.pandas_udf("array<string>")
    def pages(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def text_of(page) -> str:
            try:
                return (page() if callable(page) else page) or ""
            except Exception:  # noqa: BLE001  one broken page must not end the file
                return ""

        def attempt(content: bytes) -> list[str]:
            try:
                return [text_of(p) for p in read(content)]
            except Exception:  # noqa: BLE001  one broken file must not end the scan
                return []

        for batch in batches:
            yield batch.map(attempt)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    read_pages = files.select("path", pages("content").alias("_pages"))
    return read_pages.select("path", F.array_join("_pages", "\n\n").alias("text"), F.size("_pages").alias("pages"))


def needs_ocr(text: Column, pages: Column) -> Column:
    return (F.length(F.coalesce(text, F.lit(""))) == 0) | (F.length(text) < OCR_CHARS_A_PAGE * pages)


def rich_text(tree: Column, between: str = " ") -> Column:
    """The non-blank texts of a rich-text tree in JSON, depth first."""
    import json

    def walk(node: object) -> Iterator[str]:
        stack = [node]
        while stack:
            node = stack.pop()
            if isinstance(node, dict):
                text = node.get("text")
                if isinstance(text, str) and text.strip():
                    yield text.strip()
                stack += reversed([*(node.get("children") or []), *([node["root"]] if "root" in node else [])])
            elif isinstance(node, list):
                stack += reversed(node)

    @F.pandas_udf("string")
    def flat(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(value: str | None) -> str:
            try:
                return between.join(walk(json.loads(value))) if value else ""
            except ValueError:
                return ""

        for batch in batches:
            yield batch.map(one)

    return flat(tree)


def joined_text(tree: Column) -> Column:
    """A rich-text tree in JSON as the extractor reads it: a node's own text wins over its children, which are joined by
    newlines, blank ones too; a node with neither is empty. What is no JSON is empty."""
    import json

    @F.pandas_udf("string")
    def flat(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def walk(node: object) -> str:
            done: list[str] = []
            # A node, or None where as many texts as stand beside it are to be joined.
            todo: list[tuple[object, int]] = [(node, 0)]
            while todo:
                node, joins = todo.pop()
                own = node.get("text") if isinstance(node, dict) else node
                below = node.get("children", []) if isinstance(node, dict) else node
                if joins:
                    done[-joins:] = ["\n".join(done[-joins:])]
                elif isinstance(own, str):
                    done.append(own)
                elif isinstance(below, list) and below:
                    todo.append((None, len(below)))
                    todo += [(x, 0) for x in reversed(below)]
                else:
                    done.append("")
            return done[0]

        def one(value: str | None) -> str:
            try:
                return walk(json.loads(value)) if value else ""
            except ValueError:
                return ""

        for batch in batches:
            yield batch.map(one)

    return flat(tree)
