"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskstream.session import ship_package

_OWN_DIR: dict[str, str] = {}
#: Shuffle files go when the query that wrote them ends, not when the driver collects its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; only Spark's reader touches the path."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where the setting is
    missing, a local session gets a scratch folder; a cluster raises."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="riskstream-llm-")
    return _OWN_DIR[app]


class Scratch:
    """Written intermediate tables of one operator call, which cut lineage
    and survive lost executors. ``drop`` removes those no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}-{name}"
        kept = self.spark.conf.get(_CLEAN)
        self.spark.conf.set(_CLEAN, "true")      # the written table is all that is read again
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEAN, kept)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def crc_mod(col: Column | str, n: int) -> Column:
    """crc32 of a number's decimal text, mod n; a null counts as 0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.crc32(c.cast("string")) % n, F.lit(0))


def salted_cells(rows: DataFrame, keys: list[str], is_index: Column, hash_col: Column,
                 sizes: DataFrame, block: int) -> DataFrame:
    """Deals the rows of each key to cells, so that no cell holds more than
    about ``block`` index rows and ``block`` query rows of a key.

    ``sizes`` (keys, n_entry, n_ask): how many index and query rows the large
    keys have; other keys make one cell. With a blocks of index rows and b of
    query rows a key makes a x b cells: an index row of block i goes to the
    cells (i, *), a query row of block j to the cells (*, j), so each index
    row meets each query row in one cell. Adds the columns ``ci`` and ``cj``.
    """
    def blocks(n: str) -> Column:
        return F.greatest(F.ceil(F.col(n) / F.lit(block)), F.lit(1)).cast("int")

    s = sizes.select(*keys, blocks("n_entry").alias("_a"), blocks("n_ask").alias("_b"))
    a, b = F.coalesce("_a", F.lit(1)), F.coalesce("_b", F.lit(1))
    own = F.pmod(hash_col, F.when(is_index, a).otherwise(b)).cast("int")
    others = F.when(is_index, b).otherwise(a)
    return (rows.join(s, keys, "left")
            .withColumn("_own", own)
            .withColumn("_other", F.explode(F.sequence(F.lit(0), others - 1)))
            .withColumn("ci", F.when(is_index, F.col("_own")).otherwise(F.col("_other")))
            .withColumn("cj", F.when(is_index, F.col("_other")).otherwise(F.col("_own")))
            .drop("_a", "_b", "_own", "_other"))
