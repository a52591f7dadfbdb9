"""Manifests and tables out: written beside the target first, complete or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKER = "_COMPLETE"


def manifest(elements: DataFrame, key: str = "slide_id") -> DataFrame:
    """(slide_id, manifest): the page's elements in order as one JSON document."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct(*(c for c in elements.columns if c not in (key, "place"))).alias("e")))), lambda s: s["e"])
    return elements.groupBy(key).agg(F.to_json(F.struct(F.lit(2).alias("manifestVersion"), rows.alias("elements"))).alias("manifest"))


def sequence_name(at: Column) -> Column:
    return F.lpad(at.cast("string"), 3, "0")


def published(df: DataFrame, target: str, form: str = "parquet") -> None:
    """Writes to a folder beside ``target`` and renames it; an older target is moved aside first and comes back if the rename fails.

    Only a folder that bears the marker of this function is ever replaced. All of it goes through Hadoop's file systems.
    """
    spark = df.sparkSession
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    target = target.rstrip("/")
    token = uuid.uuid4().hex
    staged, aside = f"{target}.staged-{token}", f"{target}.previous-{token}"
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path(target)) and not fs.exists(path(f"{target}/{MARKER}")):
        raise FileExistsError(f"{target} was not published here")
    try:
        df.write.format(form).save(staged)
        fs.create(path(f"{staged}/{MARKER}")).close()
        held = fs.exists(path(target))
        if held and not fs.rename(path(target), path(aside)):
            raise OSError(f"{target} can't be moved aside")
        if not fs.rename(path(staged), path(target)):
            if held:
                fs.rename(path(aside), path(target))
            raise OSError(f"{target} can't be published")
        if held:
            fs.delete(path(aside), True)
    finally:
        fs.delete(path(staged), True)
