"""Tables written to the folder that all executors share, and small helpers around them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; outside a cluster, where none is named, a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="quern-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_ROOTS: list[str] = []


def sweep(spark: SparkSession) -> None:
    """Removes what this driver's runs have left in the shared folder. Results are read from there as long as they are lazy, so call it once they are written."""
    while _ROOTS:
        _remove(spark, _ROOTS.pop())


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Parquet tables of one run in the shared folder: they cut lineage and survive the loss of executors. Operators drop those that nothing reads any more; sweep() removes the rest."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"
        _ROOTS.append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """df, written and read again. zstd is for texts only: Spark tells a table's size from its files', and ids that pack well would look small enough to be broadcast."""
        df.write.option("compression", compression).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        _remove(self.spark, self.path(name))


def words_count(text: Column) -> Column:
    """Words of a text: maximal runs without blank, tab or line end; 0 for a null or empty text."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long")


WORDS_SQL = "coalesce(len(regexp_extract_all({text}, '[^ \\t\\n\\r]+')), 0)::BIGINT"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sent_whole_if_small(df: DataFrame, size: Column, limit: int = 32 << 20) -> DataFrame:
    """df with a broadcast hint if the sum of `size`, the bytes of a row, is within limit; else as it is, so that a join moves both sides. df should be a saved table, as it's read once more for the sum."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= limit else df
