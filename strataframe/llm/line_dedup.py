"""Lines that other documents hold already are dropped (SQL functions only); what comes back to the texts are bitmaps.

A line's key is the line without white space at its ends and with A-Z in lower case. Keys of at least ``LEAST`` code points that several documents
hold stay only in the document with the smallest id, with all their lines there.

1. Each such line becomes a narrow row (h, g, id, x, pos): two 64-bit hashes of its key, its document's id, the hash of its text, its
   position. These rows are written once.
2. A sketch of bounded size finds the keys that more than a ``HOT``-th of all lines have, and one aggregate their exact first documents. At most
   ``HOT`` rows are broadcast.
3. Rows are range-partitioned by h and sorted by (h, g, id, pos) in each range, where the first row of a key streams before all others of
   it. Rows of a hot key need no such stream, for its first document is known, and are spread over all ranges by their own documents. So no
   range is larger than its share and a ``HOT``-th of the lines.
4. Lines to be dropped come together by document as a bitmap, of which only 64-bit words with a bit set are kept.
5. Texts meet their bitmaps in one join; no line's text is ever shuffled but as a part of its document.

Defined cases: a null or empty text is one empty line; rows that share an id are one document, so they don't lose lines to each other, and
each row is returned; a null id is a document behind all others; shorter keys stay; a text whose lines all go becomes empty; texts of any length
are whole; an empty table gives an empty result; :func:`without_repeats` returns all other columns whatever their names.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataframe.llm.shared import read, stored

LEAST = 10
#: Keys of more than a HOT-th of the lines are hot; the sketch tracks eight times as many. MERGED sketches are merged apart first.
HOT, MERGED = 4096, 256
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def _lower(line: Column) -> Column:
    """A-Z in lower case and nothing else."""
    return F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(F.translate(line, ascii_uppercase, ascii_lowercase))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keys(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h, g, id, x, pos): the lines whose keys are long enough."""
    text = F.col(f"`{text_col}`")
    each = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("x"), F.posexplode(_lines(text)).alias("pos", "line"))
    each = each.withColumn("line", F.btrim("line", F.lit(WHITE))).where(F.length("line") >= least).withColumn("line", _lower(F.col("line")))
    return each.select(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), "id", "x", "pos")


def hot_keys(lines: DataFrame, hot: int = HOT) -> DataFrame:
    """(h, g, first): keys of more than a ``hot``-th of all lines, at most ``hot`` values of h, and the smallest id of their documents."""
    sketched = lines.groupBy((F.spark_partition_id() % MERGED).alias("part")).agg(F.expr(f"approx_top_k_accumulate(h, {8 * hot})").alias("s"), F.count(F.lit(1)).alias("n"))
    top = sketched.groupBy((F.col("part") * 0).alias("all")).agg(F.expr(f"approx_top_k_combine(s, {8 * hot})").alias("s"), F.sum("n").alias("n")).select(F.explode(F.expr(f"approx_top_k_estimate(s, {hot})")).alias("top"), "n")
    found = stored(top.where(F.col("top.count") * hot > F.col("n")).select(F.col("top.item").alias("h")), "hot")
    return lines.join(F.broadcast(found), "h", "left_semi").groupBy("h", "g").agg(F.min("id").alias("first"))


def repeats(lines: DataFrame, hot: int = HOT) -> DataFrame:
    """(id, x, pos): the lines that go. ``lines`` is a stored table."""
    known = stored(hot_keys(lines, hot), "firsts").withColumn("known", F.lit(True))
    dealt = lines.join(F.broadcast(known), ["h", "g"], "left").withColumn("range", F.when(F.col("known"), F.xxhash64("id", "x", "pos")).otherwise(F.col("h")))
    stream = Window.partitionBy("range", "h", "g").orderBy(F.col("id").asc_nulls_last(), "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.when(F.col("known"), F.col("first")).otherwise(F.first("id").over(stream))
    return dealt.repartitionByRange("range").withColumn("holder", first).where(~F.col("id").eqNullSafe(F.col("holder"))).select("id", "x", "pos")


def bitmaps(gone: DataFrame) -> DataFrame:
    """(id, x, drops, n_dropped): for each text with such lines its bitmap, as (word, bits) of the 64-bit words that have any bit set, in order."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % 64).cast("int"))
    words = gone.repartition("id", "x").groupBy("id", "x", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    drops = F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("drops")
    return words.groupBy("id", "x").agg(drops, F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"))


def spread(drops: Column) -> Column:
    """All words of a bitmap up to the last that has a bit set."""
    gap = lambda d, i: d["word"] - F.when(i > 0, F.get(drops, i - 1)["word"]).otherwise(-1) - 1
    return F.flatten(F.transform(drops, lambda d, i: F.concat(F.array_repeat(F.lit(0).cast("long"), gap(d, i)), F.array(d["bits"]))))


def without_repeats(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """The rows of ``docs``, each text with its kept lines only, and two more columns, n_lines and n_dropped."""
    gone = bitmaps(repeats(stored(keys(docs, least, id_col, text_col), "lines"), hot))
    maps = gone.select(F.col("id").alias("__id"), F.col("x").alias("__x"), spread(F.col("drops")).alias("__bits"), F.col("n_dropped").alias("__dropped"))
    text, bits = F.col(f"`{text_col}`"), F.col("__bits")
    own = docs.withColumn("__text_hash", F.xxhash64(F.coalesce(text, F.lit(""))))
    both = own.join(maps.hint("shuffle_hash"), (F.col("__text_hash") == F.col("__x")) & F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__id")), "left")
    set_ = lambda i: F.coalesce(F.call_function("getbit", F.get(bits, F.floor(i / 64).cast("int")), i % 64), F.lit(0).cast("tinyint"))
    kept = F.when(bits.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.filter(_lines(text), lambda _, i: set_(i) == 0), "\n"))
    n_lines = F.size(_lines(text)).cast("long").alias("n_lines")
    return both.select(*(kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns), n_lines, F.coalesce("__dropped", F.lit(0)).cast("long").alias("n_dropped"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
d AS (SELECT k.doc_id, k.line, k.pos, coalesce(k.doc_id > f.first, FALSE) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id
"""
