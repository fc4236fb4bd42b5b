"""Registry of queries, and SQL that several of them share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

_QUERIES: dict = {}
_SQL: dict = {}


def register(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_sql(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({c}, ''), '[{tx.BLANK}]+'), lambda x: x <> '')"


def token_id(word):
    """A stand-in for a vocabulary that SQL can state: 16 bits of the word's MD5."""
    return F.conv(F.substring(F.md5(word), 1, 4), 16, 10).cast("int")


TOKEN_SQL = "('0x' || substr(md5({w}), 1, 4))::INTEGER"
