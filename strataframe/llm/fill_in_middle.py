"""Fill-in-the-middle transformation with big integers as bit masks, one bit for each byte of a text.

``bytes.translate`` turns a text's UTF-8 bytes into classes ("ends a line", "begins a code point"), read as a number whose bit i is byte i.
Boundaries are shifted boolean operations on it, ``bit_count`` counts lines and code points, and the bit of a given rank is found by halving
the number again and again, which touches each word about twice. So no text is split into lines, and no list of boundaries is made.

A text is n units (``[^\\n]*\\n|[^\\n]+``). Four numbers, from a keyed hash of the document's id, cut it and choose its form:

    psm   <P>prefix<S>suffix<M>middle
    spm   <S>suffix<P>prefix<M>middle
    plain the text as it is: empty ones, those that hold a marker, and 100 - ``rate`` of a hundred others

Rows are transformed where they lie: no shuffle, and batches leave a task once they hold ``BATCH`` bytes.

Defined cases: a null text is empty; a null id counts as the empty string in the hash; rows that repeat an id are cut alike if their texts are
equal; texts of any length are cut whole; bytes that are no UTF-8 are kept as they are; an empty table gives an empty result; other columns
aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm.shared import read

SEED, RATE, SPM = 7, 100, 50
MARKERS = PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
BATCH = 32 << 20
_ENDS = bytes(ord("1") if b == ord("\n") else ord("0") for b in range(256))
_LEADS = bytes(ord("0") if 0x80 <= b < 0xC0 else ord("1") for b in range(256))


def mask(data: bytes, table: bytes) -> int:
    """A number whose bit i says whether byte i is of the table's class."""
    return int(data.translate(table)[::-1], 2) if data else 0


def starts(data: bytes) -> int:
    """Marks the bytes that begin a unit: the first one, and whatever follows a line feed inside the text."""
    return ((mask(data, _ENDS) << 1) | 1) & ((1 << len(data)) - 1)


def select(bits: int, rank: int, size: int) -> int:
    """Place of the set bit of a rank (from 0) in a number of ``size`` bits."""
    at = 0
    while size > 1:
        half = size // 2
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            bits, size = low, half
        else:
            bits, size, rank, at = bits >> half, size - half, rank - below, at + half
    return at


def cut(data: bytes, doc_id: int | None, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, bytes]:
    """(n, form, code points of the prefix, of the middle, output) of one text."""
    begins = starts(data)
    n = begins.bit_count()
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[4 * k : 4 * k + 4]) for k in range(4))
    if not data or h3 % 100 >= rate or any(m in data for m in MARKERS):
        return n, "plain", None, None, data
    first, second = (select(begins, k, len(data)) if k < n else len(data) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    leads = mask(data, _LEADS)
    before, upto = ((leads & ((1 << at) - 1)).bit_count() for at in (first, second))
    prefix, middle, suffix = data[:first], data[first:second], data[second:]
    if h4 % 100 < spm:
        return n, "spm", before, upto - before, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", before, upto - before, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def transformed(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: one row for each row of ``docs``."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[tuple] = []
            size = 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.append((doc_id, *cut(text.as_py() or b"", doc_id, seed, rate, spm)))
                size += len(held[-1][-1])
                if size >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    bytes_of = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    out = bytes_of.mapInArrow(rows, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text of an output: what stands between its markers, in the old order."""
    part = lambda k: F.element_at(F.split(output, "<[PSM]>", -1), k)
    return F.when(form == "psm", F.concat(part(2), part(4), part(3))).when(form == "spm", F.concat(part(3), part(4), part(2))).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transformed(read(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, len(u) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:n], ''), '') AS suf FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
