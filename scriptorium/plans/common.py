"""What query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import FOLD_FROM, FOLD_TO, STOP_WORDS, TOKEN, WHITE
from ..operators import textindex
from ..sources.scratch import folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, with SQL for the same rows where SQL can state them."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_index(spark: SparkSession, sf_dir: str) -> textindex.TextIndex:
    """The index of the documents' texts, which queries of one session share."""
    return textindex.kept(table(spark, sf_dir, "documents").select("doc_id", "text", "_metadata"), folder(spark))


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


#: White space of any script, as DuckDB's expressions name it.
SQL_SPACE = "[\\s\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+"


def sql_tokens(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"list_filter(regexp_extract_all({sql_collapsed(f'lower(nfc_normalize({text}))')}, '{TOKEN}'), lambda t: length(t) > 1 and not list_contains([{stop}], t))"


def sql_bucket(parts: str, of: int) -> str:
    return f"(cast('0x' || substr(md5({parts}), 1, 7) as bigint) % {of})"


def sql_fold(text: str) -> str:
    return f"translate({text}, '{FOLD_FROM}', '{FOLD_TO}')"


def sql_plain(token: str) -> str:
    """A token without accents."""
    return f"translate({token}, '{textindex.ACCENTED}', '{textindex.PLAIN}')"


def sql_stripped(text: str) -> str:
    """Without white space of any script at either end."""
    return f"trim({text}, {' || '.join(f'chr({ord(c)})' for c in WHITE)})"


def sql_collapsed(text: str) -> str:
    return f"trim(regexp_replace({text}, '{SQL_SPACE}', ' ', 'g'))"


def long(c):
    return c.cast("long") if hasattr(c, "cast") else F.col(c).cast("long")
