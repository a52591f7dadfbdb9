"""Helpers that the training-data operators share: reading tables, durable tables between jobs, salted joins, survivors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all word definitions here: space, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]"
#: Salts of joins whose keys may be hot: as many as a long has bits.
SALTS = 64
#: At most so many rows of a few dozen bytes each are broadcast (some 50 MB); beyond that, rows are shuffled.
BROADCAST_ROWS = 500_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder, through Spark's own reader whatever store the folder is in."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the session has none and runs on this machine alone (tests) a temporary folder is made; on a cluster that is an error,
    for there each executor would write to a disk of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = getattr(spark.sparkContext, "_strataframe_scratch", None)
        if not at:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            at = "file://" + tempfile.mkdtemp(prefix="strataframe-")
            spark.sparkContext._strataframe_scratch = at
    return at.rstrip("/")


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and any executor can be lost later.

    What :func:`removed` hasn't deleted goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/strataframe-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    fs, top = _folder(spark, path.rsplit("/", 1)[0])
    if fs.mkdirs(top):
        fs.deleteOnExit(top)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Delete tables of :func:`stored` that nothing will read again."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            fs, at = _folder(df.sparkSession, path)
            fs.delete(at, True)


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a (stored) table is small enough for a broadcast."""
    return df.limit(rows + 1).count() <= rows


def least_hashed(df: DataFrame, order: Column, n: int) -> DataFrame:
    """Of a table with more than 4 n different values of ``order``, a hash, the rows of about the 2 n least values, so that a later "first n by hash" gathers little.

    Different values are counted, not rows, so repeated keys don't move the cut. That count is an estimate (to 5 %, one standard
    deviation), and n values at least are among those kept but for odds far below one in a billion for n of some hundreds.
    """
    total = df.agg(F.approx_count_distinct(order)).first()[0]
    return df if total <= 4 * n else df.where(order <= F.lit(2 * n * (1 << 64) // total - (1 << 63)))


def salt(*of: str) -> Column:
    """A row's salt, from columns that differ between the rows of a hot key."""
    return F.pmod(F.xxhash64(*of), F.lit(SALTS)).cast("int")


def salts(*of: str) -> Column:
    """Aggregate: which salts the rows of a group have."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), salt(*of)))


def each_salt(df: DataFrame, mask: str = "salts") -> DataFrame:
    """A row for each salt that the group uses (column salt), so that a join with its rows on (key, salt) is dealt evenly."""
    used = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.call_function("getbit", F.col(mask), i) == 1)
    return df.withColumn("salt", F.explode(used)).drop(mask)


def row_key(df: DataFrame) -> Column:
    """128 bits of all columns of a row; equal rows have equal keys."""
    return F.unhex(F.md5(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}).cast("binary")))


def survivors(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, by row and not by id.

    ``judged`` has a row for some rows of ``docs``: __row (:func:`row_key`) and __first, whether it stays. Rows not in it stay. Of rows that
    are equal in all columns, and so have one key, one stays if any does. What goes, and the few keys of such copies, are
    broadcast if they are few; else they are joined by the key, and only then texts are shuffled.
    """
    by_row = stored(judged.groupBy("__row").agg(F.max("__first").alias("first"), F.count(F.lit(1)).alias("n")).where("not first or n > 1"), "judged")
    small = few(by_row)
    hint = F.broadcast if small else (lambda df: df)
    keyed = docs.withColumn("__row", row_key(docs))
    rest = keyed.join(hint(by_row.select("__row")), "__row", "left_anti").select(*docs.columns)
    copies = by_row.where("first").select("__row")
    if copies.isEmpty():
        return rest
    columns = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    again = keyed.join(hint(copies), "__row", "left_semi").groupBy("__row").agg(F.first(columns).alias("__all"))
    return rest.unionByName(again.select("__all.*"))
