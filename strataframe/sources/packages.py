"""Packages of many pages: artifacts and, written last, the ledgers that name them with their digests.

``artifacts``: package_id, path, bytes. ``entries``: package_id, path, sha256, what each ledger names. ``ledgers``: package_id, version, width,
height, metadata (JSON). A store is a folder with one subfolder for each publication; what has no finished ledger table isn't there for
readers, so a publication that stops leaves nothing behind that could be read. Bytes are hashed where they lie; only digests are joined.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.functions import text as t

KEY, VERSIONS, SOURCE, PIXEL_BYTES = "package_id", (1, 2), "source.rgba", 4
#: Payloads that metadata may not hold: images as data URLs, and strings of base64 from this length on.
EMBEDDED, OPAQUE, LONG = "(?i)data:image/", r"^(?:[A-Za-z0-9+/]{4})+(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$", 2048


def _found(df: DataFrame, fault: str, path: Column | str | None = None) -> DataFrame:
    return df.select(KEY, F.lit(fault).alias("fault"), (F.lit(None).cast("string") if path is None else F.col(path) if isinstance(path, str) else path).alias("path"))


def strings_of(metadata: Column) -> Column:
    """All string values of a JSON text, unescaped, at any depth; null if it is no JSON."""
    quoted = F.regexp_extract_all(metadata, F.lit(r'"(?:[^"\\]|\\.)*+"(?:\s*+:)?+'), F.lit(0))
    values = F.filter(quoted, lambda q: ~F.endswith(q, F.lit(":")))
    return F.when(F.try_parse_json(metadata).isNotNull(), F.transform(values, lambda q: F.replace(F.substr(q, F.lit(2), F.length(q) - 2), F.lit("\\/"), F.lit("/"))))


def ledger_faults(ledgers: DataFrame, entries: DataFrame) -> DataFrame:
    """(package_id, fault, path): what is wrong with ledgers by themselves."""
    once = ledgers.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    held = ledgers.withColumn("strings", strings_of(F.col("metadata")))
    bad = lambda test: F.exists("strings", test)
    named = entries.groupBy(KEY, "path").agg(F.count(F.lit(1)).alias("n"))
    faults = [
        _found(once.where("n > 1"), "ledger_repeated"),
        _found(held.where(~F.coalesce(F.col("version").isin(*VERSIONS), F.lit(False))), "version_unsupported"),
        _found(held.where(~F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False))), "canvas_invalid"),
        _found(held.where(F.col("metadata").isNotNull() & F.col("strings").isNull()), "metadata_no_json"),
        _found(held.where(bad(lambda s: s.rlike(EMBEDDED))), "metadata_image"),
        _found(held.where(bad(lambda s: (F.length(s) >= LONG) & s.rlike(OPAQUE))), "metadata_opaque"),
        _found(named.where("n > 1"), "path_repeated", "path"),
        _found(named.where(~F.coalesce(t.safe_relative_path(F.col("path")), F.lit(False))), "path_unsafe", "path"),
        _found(entries.where(~F.coalesce(F.col("sha256").rlike("^[a-f0-9]{64}$"), F.lit(False))).select(KEY, "path").distinct(), "digest_malformed", "path"),
        _found(entries.select(KEY).distinct().join(ledgers.select(KEY), KEY, "left_anti"), "ledger_missing"),
    ]
    return reduce(DataFrame.unionByName, faults)


def faults(ledgers: DataFrame, entries: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(package_id, fault, path): ledgers as above, and both ways between what they name and what is there; the source must have four bytes a pixel."""
    there = artifacts.select(KEY, "path", F.sha2("bytes", 256).alias("found"), F.octet_length("bytes").alias("size"))
    both = entries.select(KEY, "path", "sha256", F.lit(True).alias("named")).join(there.withColumn("there", F.lit(True)), [KEY, "path"], "full")
    source = there.where(F.col("path") == SOURCE).join(ledgers.select(KEY, "width", "height"), KEY)
    more = [
        _found(both.where("there is null"), "artifact_missing", "path"),
        _found(both.where("named is null"), "artifact_unlisted", "path"),
        _found(both.where("named and there and not sha256 <=> found"), "digest_mismatch", "path"),
        _found(source.where(F.col("size") != F.col("width") * F.col("height") * PIXEL_BYTES), "source_length", F.lit(SOURCE)),
    ]
    return reduce(DataFrame.unionByName, more, ledger_faults(ledgers, entries)).distinct()


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def publications(spark: SparkSession, folder: str) -> list[str]:
    """The finished publications of a store, as folders, in order of their names."""
    fs, at = _fs(spark, folder)
    held = sorted(s.getPath().toString() for s in fs.listStatus(at)) if fs.exists(at) else []
    return [p for p in held if fs.exists(_fs(spark, f"{p}/ledgers/_SUCCESS")[1])]


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ledgers, entries, artifacts) of all finished publications of a store."""
    at = publications(spark, folder)
    if not at:
        raise FileNotFoundError(f"nothing is published in {folder}")
    return tuple(spark.read.parquet(*(f"{p}/{name}" for p in at)) for name in ("ledgers", "entries", "artifacts"))


def verified(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(artifacts of packages without a fault, faults of the others)."""
    ledgers, entries, artifacts = read(spark, folder)
    wrong = faults(ledgers, entries, artifacts)
    return artifacts.join(wrong.select(KEY).distinct(), KEY, "left_anti"), wrong


def publish(ledgers: DataFrame, entries: DataFrame, artifacts: DataFrame, folder: str) -> str:
    """Adds packages to a store: artifacts first, read back and verified as they lie there, then entries, and ledgers last. All or nothing.

    A package that is there already, or any fault, is an error, and what was written goes.
    """
    spark = ledgers.sparkSession
    target = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    fs, at = _fs(spark, target)
    try:
        if publications(spark, folder):
            again = ledgers.select(KEY).join(read(spark, folder)[0].select(KEY), KEY, "left_semi")
            if not again.isEmpty():
                raise FileExistsError(f"package {again.first()[0]} is published already")
        artifacts.write.parquet(f"{target}/artifacts")
        entries.write.parquet(f"{target}/entries")
        wrong = faults(ledgers, spark.read.schema(entries.schema).parquet(f"{target}/entries"), spark.read.schema(artifacts.schema).parquet(f"{target}/artifacts")).orderBy(KEY, "fault", "path").limit(5).collect()
        if wrong:
            raise ValueError("; ".join(f"{w[KEY]}: {w['fault']} {w['path'] or ''}".strip() for w in wrong))
        ledgers.write.parquet(f"{target}/ledgers")
    except BaseException:
        fs.delete(at, True)
        raise
    return target
