"""Exact duplicate groups by content hash, with the bytes compared inside each group (SQL functions only).

Two texts are equal if they are identical once every character of ``[\\x20\\x09-\\x0D]`` is deleted.

1. One pass makes a narrow row of each document: id, length, MD5 and SHA-256 of the normalised text, XXH64 of the text as it is.
2. Narrow rows are counted by MD5. Hashes with two rows or more are *crowded*; all other rows are groups of their own.
3. Only the texts of crowded hashes move: they are picked by the XXH64 of the text as it is (a broadcast if those hashes are
   few, else texts move all) and grouped by the MD5 *and by the text itself*, so two texts that only share the hash form two groups.
4. The groups go back to the narrow rows by (MD5, SHA-256, salt).

Partial aggregation keeps one row for each text and task before the shuffle, so a text that a third of all rows hold is no hot key. Each group
also records which of 64 salts its rows use; the join that takes it back to its rows is dealt evenly for the same reason.

Defined cases: a null text counts as the empty text, which is an ordinary text; of equally long texts the
smallest id stays, whatever its sign; a null id stays only if its group has no other id of that length; rows that repeat an id
and its text count in ``group_size`` and share its ``kept``, but :func:`without_copies` keeps one row of a group only; an empty table gives
an empty result; other columns are not read, and :func:`without_copies` returns them whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm.shared import SPACE, each_salt, few, read, row_key, salt, salts, stored, survivors


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def _md5(norm: Column) -> Column:
    return F.unhex(F.md5(norm.cast("binary")))


def _sha(norm: Column) -> Column:
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def _order(*more: str) -> Column:
    """The best row of a group is the least: most code points, then the smallest id, nulls last."""
    return F.struct((-F.col("n")).alias("neg"), F.col("id").isNull().alias("none"), F.col("id"), *more)


def _narrow(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """id, n, x (XXH64 of the text as it is), h (MD5), sha of each row; stored, for several jobs read it."""
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), normalised(F.col(text_col)).alias("norm"), *more)
    rest = [c for c in text.columns if c not in ("id", "text", "norm")]
    return stored(text.select("id", F.length("text").alias("n"), F.xxhash64("text").alias("x"), _md5(F.col("norm")).alias("h"), _sha(F.col("norm")).alias("sha"), *rest), "hashes")


def _classes(docs: DataFrame, rows: DataFrame, text_col: str) -> DataFrame:
    """(h, sha, size, salts): the groups of two rows or more by their bytes, beside which there may be groups of one."""
    crowded = stored(rows.groupBy("h").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("h"), "crowded")
    wanted = stored(rows.join(F.broadcast(crowded), "h", "left_semi").select("x").distinct(), "wanted") if few(crowded) else None
    text = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if wanted is not None and few(wanted):
        text = text.withColumn("x", F.xxhash64("text")).join(F.broadcast(wanted), "x", "left_semi")
    texts = text.select(normalised(F.col("text")).alias("norm"))
    same_bytes = texts.groupBy(_md5(F.col("norm")).alias("h"), "norm").agg(F.count(F.lit(1)).alias("size")).select("h", _sha(F.col("norm")).alias("sha"), "size")
    # One class for each pair of hashes, or the query stops: rows find their class by the two hashes alone.
    return (
        same_bytes.groupBy("h", "sha")
        .agg(F.count(F.lit(1)).alias("n_classes"), F.max("size").alias("size"))
        .withColumn("size", F.when(F.col("n_classes") == 1, F.col("size")).otherwise(F.raise_error(F.lit("two texts share MD5 and SHA-256")).cast("long")))
        .where("size > 1")
        .select("h", "sha", "size")
    )


def _grouped(docs: DataFrame, rows: DataFrame, text_col: str, *tie: str) -> DataFrame:
    """``rows`` with size (null: alone) and best, the least order of their group."""
    best = rows.groupBy("h", "sha").agg(F.min(_order(*tie)).alias("best"), F.count(F.lit(1)).alias("n_rows"), salts("id", "x", *tie).alias("salts")).where("n_rows > 1")
    groups = each_salt(best.join(_classes(docs, rows, text_col), ["h", "sha"]).select("h", "sha", "size", "best", "salts"))
    return rows.withColumn("salt", salt("id", "x", *tie)).join(groups, ["h", "sha", "salt"], "left")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of ``docs``."""
    keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("best.id"))
    return (
        _grouped(docs, _narrow(docs, id_col, text_col), text_col)
        .withColumn("keep_id", keep)
        .select(
            F.col("id").alias("doc_id"), "keep_id", F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
        )
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group."""
    rows = _narrow(docs, id_col, text_col, row_key(docs).alias("__row"))
    judged = _grouped(docs, rows, text_col, "__row").where("size is not null")
    return survivors(docs, judged.select("__row", (F.col("__row") == F.col("best.__row")).alias("__first")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256 FROM d JOIN g USING (norm)
"""
