"""SimHash near-duplicate groups by covering locality-sensitive hashing.

A fingerprint has 64 bits, of three-word shingles hashed with XXH64; two fingerprints are linked if they differ
in at most ``RADIUS`` = 2 bits. Every bit position i is given a vector phi(i) of three bits, and each of the seven
non-zero vectors v is a table whose mask keeps the positions where the inner product of phi(i) and v is odd. For any
two positions there is a v that is orthogonal to both, so any pair within two bits agrees on the whole key of that
table: no link is lost, whatever the fingerprints are.

Copies fall together first (one row for each fingerprint). A bucket of two is compared directly. In a larger one
each fingerprint is filed under its *centres*, itself and itself with one of the bits that the table masks out:
two fingerprints that share a centre differ in two bits at most, and any two of a bucket within two bits share one.
A centre has at most 65 fingerprints around it, so they are linked to the least of them and no bucket, however
large, is expanded into pairs. Components then come from :mod:`components`. Keys have 36 or 37 bits, so with some 10^11 different
fingerprints nearly every bucket is crowded, and a fingerprint then costs up to 7 times about 30 short rows: linear, but a large factor.

Defined cases: a null text counts as empty; no words give fingerprint zero, which links like any other; fewer than
three words are one shingle; a row that repeats an id is one more document with that id; the id of a component is
the least id in it (nulls are never the least unless alone); :func:`one_of_each_group` keeps one row of a component, of rows
with its least id one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm.components import components
from strataframe.llm.shared import each_salt, read, removed, row_key, salt, salts, stored, survivors

WIDTH, SEED, BLOCK, RADIUS = 3, 42, 1 << 15, 2


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: phi(i) runs over the seven non-zero vectors, so every mask keeps about four sevenths of the positions.
PHI = [i % 7 + 1 for i in range(64)]
TABLES = [sum(1 << i for i in range(64) if bin(PHI[i] & v).count("1") % 2) for v in range(1, 8)]


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    """The unsigned fingerprint: a bit is one if more than half of the shingles' hashes have it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    stops = (ends[width - 1 :] - 1).tolist() if len(words) >= width else [len(line)]
    starts = starts[:n].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):  # bounded memory for a text of any length
        h = np.array([digest(line[i:j], seed) for i, j in zip(starts[k : k + BLOCK], stops[k : k + BLOCK], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def fingerprints(own: DataFrame) -> DataFrame:
    """The columns of ``own`` with fp, the fingerprint as a signed long, in place of text."""
    rest = [c for c in own.columns if c != "text"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([signed(fingerprint(t.as_py())) for t in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), fp], [*rest, "fp"])

    return own.mapInArrow(rows, ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in rest) + ", fp long")


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect whatever lies within two bits."""
    keys = F.array(*[F.struct(F.lit(k).alias("table"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("key")) for k, mask in enumerate(TABLES)])
    filed = fps.select("fp", F.explode(keys).alias("t")).select("fp", "t.table", "t.key")
    buckets = stored(filed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "buckets")
    pairs = buckets.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)).select("a", "b")
    crowded = filed.join(buckets.where("n > 2").select("table", "key"), ["table", "key"])
    flips = [F.array(*[F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(64) if not mask >> i & 1]]) for mask in TABLES]
    flip = F.element_at(F.array(*flips), F.col("table") + 1)
    around = crowded.select("fp", F.explode(F.transform(flip, lambda x: F.col("fp").bitwiseXOR(x))).alias("centre"))
    # At most 65 distinct fingerprints have a centre.
    stars = around.groupBy("centre").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    spokes = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a != b")
    return pairs.union(spokes).distinct()


def _grouped(rows: DataFrame, *tie: str) -> DataFrame:
    """``rows`` (doc_id, fp, tie) with best, the least (null?, doc_id, tie) of their component, and n, its rows."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), *tie)
    fps = rows.groupBy("fp").agg(F.min(order).alias("own"), F.count(F.lit(1)).alias("own_n"), salts("doc_id", *tie).alias("salts"))
    edges = stored(links(fps.select("fp")), "links")
    roots = components(edges)
    joined = stored(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "own", "own_n", "salts", F.coalesce("root", "fp").alias("root")), "roots")
    removed(edges)
    # Components of one fingerprint are known already; a large one is dealt by salts of its fingerprints.
    least = joined.groupBy("root").agg(F.min("own").alias("best"), F.sum("own_n").alias("n"), F.count(F.lit(1)).alias("fps"), salts("fp").alias("fp_salts")).where("fps > 1")
    least = each_salt(least.select("root", "best", "n", "fp_salts"), "fp_salts")
    known = joined.withColumn("salt", salt("fp")).join(least, ["root", "salt"], "left").select("fp", F.coalesce("best", "own").alias("best"), F.coalesce("n", "own_n").alias("n"), "salts")
    return rows.withColumn("salt", salt("doc_id", *tie)).join(each_salt(known), ["fp", "salt"]).drop("salt")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least id of the component): one row for each row of ``docs``."""
    rows = stored(fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))), "fingerprints")
    return _grouped(rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.id").alias("component_id"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each component, that with the least id (of those, the least row key)."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row_key(docs).alias("__row"))
    judged = _grouped(stored(fingerprints(own), "fingerprints"), "__row").where("n > 1")
    return survivors(docs, judged.select("__row", (F.col("__row") == F.col("best.__row")).alias("__first")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"))
