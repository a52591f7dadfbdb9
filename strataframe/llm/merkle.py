"""A manifest of a dataset as a Merkle tree: a subroot for each source, a root over the subroots, and a proof for each document.

Level by level, all in DataFrames:

1. *Leaves*: digests of documents, from one scan; texts are hashed where they lie and don't move.
2. *Indices*: leaves are range-partitioned by (source, id) and stored, so that each range is a piece of the order; a leaf's index is its
   ``row_number`` in its range and source, plus the leaves of its source in earlier ranges. A source with a third of all rows lies in many ranges.
3. *Levels*: index div ``FANOUT`` names a node's parent; the sorted array of a parent's children is hashed into the parent, until each source has one
   node. Each level is written once, a third of the size of the one below. Subroots, in order of their sources, are the leaves of one more such tree.
4. *Proofs* go down again: a level's arrays of children join with the proofs of their parents, and each child appends its siblings in
   front of its parent's. The joins shrink with the levels, so all of them together move about half as many rows as there are leaves, where
   joins from each leaf upwards would move all leaves at every level.

A proof is an array of (left, right), the digests beside a node in its run; folding a leaf's digest through it gives the root.

Defined cases: null fields are ``-`` in a leaf; a null source is a source of its own, before all others; null ids come first, repeated ids
in the order of their digests, and each row is a leaf; a lone leaf is its source's subroot, a lone subroot the root; with no siblings at all the proof's
hash is that of the empty string; an empty table gives an empty result; other columns aren't read. Levels are as many as the largest source needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataframe.llm.shared import read, stored

FANOUT = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def field(value: Column) -> Column:
    """``-`` for null, else the count of bytes, a colon and the value."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf(*fields: Column) -> Column:
    """The digest of a document's fields (binary)."""
    return F.unhex(F.sha2(F.concat(*map(field, fields)), 256))


def text_of(digests: Column) -> Column:
    """Digests as they enter the next hash: lowercase hex."""
    return F.lower(F.hex(digests))


def joined(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b))


def indexed(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` (stored) with idx, each row's place in its group from 0, and size, the rows of the group."""
    dealt = rows.withColumn("__at", F.monotonically_increasing_id()).repartitionByRange(group, *order, "__at").withColumn("__part", F.spark_partition_id())
    dealt = stored(dealt, "dealt")
    parts = Window.partitionBy(group)
    before = dealt.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("n"))
    before = before.select(group, "__part", (F.sum("n").over(parts.orderBy("__part")) - F.col("n")).alias("before"), F.sum("n").over(parts).alias("size"))
    own = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order, "__at")) - 1
    return dealt.withColumn("own", own).join(before, [group, "__part"]).withColumn("idx", F.col("before") + F.col("own")).drop("own", "before", "__at", "__part")


def levels(nodes: DataFrame, fanout: int = FANOUT) -> tuple[list[DataFrame], list[DataFrame]]:
    """From nodes (g, idx, size, h, data): the stored levels (g, idx, size, h, kids), lowest first, and for each level its groups' last nodes (g, h, data)."""
    up, tops = [], [nodes.where("size = 1").select("g", "h", "data")]
    left = nodes.agg(F.max("size")).first()[0] or 0
    while left > 1:
        kid = F.struct("idx", "h", "data") if "data" in nodes.columns else F.struct("idx", "h")
        runs = nodes.where("size > 1").groupBy("g", F.floor(F.col("idx") / fanout).cast("long").alias("up"))
        runs = runs.agg(F.array_sort(F.collect_list(kid), lambda a, b: F.sign(a["idx"] - b["idx"]).cast("int")).alias("kids"), F.max("size").alias("below"))
        digest = F.unhex(F.sha2(text_of(joined(F.transform("kids", lambda k: k["h"]))), 256))
        nodes = stored(runs.select("g", F.col("up").alias("idx"), F.ceil(F.col("below") / fanout).cast("long").alias("size"), digest.alias("h"), "kids"), f"level{len(up)}")
        up.append(nodes)
        tops.append(nodes.where("size = 1").select("g", "h"))
        left = -(-left // fanout)
    return up, tops


def proofs(up: list[DataFrame], tops: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(g, h, data, top, proof) of each leaf. ``tops`` has (g, h, proof, and data on the lowest level): the last nodes of each level with what lies above."""
    last = lambda k: tops[k].select("g", F.lit(0).cast("long").alias("idx"), "h", F.col("h").alias("top"), "proof", *(["data"] if k == 0 else []))
    at = last(len(up))
    for k in reversed(range(len(up))):
        beside = lambda kids, a, n: joined(F.transform(F.slice(kids, a, n), lambda s: s["h"]))
        runs = up[k].select("g", "idx", "kids").join(at.select("g", "idx", "top", "proof"), ["g", "idx"])
        step = lambda x, i: F.struct(x["idx"].alias("idx"), x["h"].alias("h"), *([x["data"].alias("data")] if k == 0 else []), beside(F.col("kids"), F.lit(1), i).alias("left"), beside(F.col("kids"), i + 2, F.lit(fanout)).alias("right"))  # noqa: E731, B023
        each = runs.select("g", "top", "proof", F.explode(F.transform("kids", step)).alias("n"))
        own = F.concat(F.array(F.struct("n.left", "n.right")), F.col("proof")).alias("proof")
        at = each.select("g", F.col("n.idx").alias("idx"), F.col("n.h").alias("h"), "top", own, *([F.col("n.data").alias("data")] if k == 0 else [])).unionByName(last(k))
    return at.drop("idx")


def no_proof() -> Column:
    return F.array().cast("array<struct<left: binary, right: binary>>")


def manifest(docs: DataFrame, fields: list[str] = FIELDS, carried: dict[str, Column] | None = None, group: str = "source", order: str = "doc_id", fanout: int = FANOUT) -> DataFrame:
    """doc_id, source, leaf, subroot, root (binary), proof (array of left and right), and ``carried`` columns: one row for each row of ``docs``."""
    g = F.coalesce(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit(""))
    data = F.struct(F.col(f"`{order}`").alias("doc_id"), F.col(f"`{group}`").alias("source"), *(c.alias(n) for n, c in (carried or {}).items()))
    leaves = docs.select(g.alias("g"), F.col(f"`{order}`").alias("id"), leaf(*(F.col(f"`{f}`") for f in fields)).alias("h"), data.alias("data"))
    nodes = stored(indexed(leaves, "g", "id", "h").drop("id"), "leaves")
    up, tops = levels(nodes, fanout)
    subroots = reduce(DataFrame.unionByName, (t.select(F.col("g").alias("id"), "h", F.struct(F.lit(k).alias("level"), "g").alias("data")) for k, t in enumerate(tops)))
    over, root = levels(stored(indexed(subroots.withColumn("g", F.lit("")), "g", "id").drop("id"), "subroots"), fanout)
    above = stored(proofs(over, [t.withColumn("proof", no_proof()) for t in root], fanout).select(F.col("data.level").alias("level"), F.col("data.g").alias("g"), "h", "top", "proof"), "above")
    of_level = [above.where(F.col("level") == k).drop("level", "top") for k in range(len(tops))]
    lone = tops[0].select("g", "data").join(of_level[0], "g")
    found = proofs(up, [lone, *of_level[1:]], fanout)
    one = above.select("top").first()
    return found.select("data.doc_id", "data.source", F.col("h").alias("leaf"), F.col("top").alias("subroot"), F.lit(bytes(one[0]) if one else None).cast("binary").alias("root"), "proof", *(f"data.{n}" for n in carried or {}))


def folded(start: Column, proof: Column) -> Column:
    """The root that a digest and a proof lead to (lowercase hex)."""
    return F.aggregate(proof, text_of(start), lambda a, s: F.sha2(F.concat(text_of(s["left"]), a, text_of(s["right"])), 256))


def siblings_digest(proof: Column) -> Column:
    """The hash of all siblings, level by level from left to right."""
    return F.sha2(text_of(joined(F.transform(proof, lambda s: F.concat(s["left"], s["right"])))), 256)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tampered documents are folded from the digest of their text without line feeds."""
    docs = read(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    forged = F.when(tampered, leaf(*(F.replace(F.col(f), F.lit("\n")) if f == "text" else F.col(f) for f in FIELDS)))
    rows = manifest(docs, carried={"forged": forged}).withColumn("folded_root", folded(F.coalesce("forged", "leaf"), F.col("proof")))
    hexed = [text_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return rows.select("doc_id", *hexed, siblings_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == text_of(F.col("root"))).alias("verified"))


#: The CRC of each id: a byte enters by exclusive or and is then shifted out, eight times.
_CRC = """crcs AS MATERIALIZED (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) AS crc FROM (SELECT DISTINCT doc_id FROM documents))"""


def _sql(depth: int = 14) -> str:
    """SQL for trees of at most 3**depth leaves a source, written out level by level."""

    def leaf_of(text: str) -> str:
        parts = [f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(parts)})"

    tamper = "replace(text, chr(10), '')"
    ctes = [f"docs AS (SELECT doc_id, coalesce('1' || source, '') AS g, {leaf_of('text')} AS leaf, {leaf_of(tamper)} AS other FROM documents)"]
    ctes.append("n0 AS MATERIALIZED (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS size, leaf AS h, doc_id, other FROM docs)")

    def tree(t: str) -> None:
        for k in range(depth):
            ctes.append(f"{t}{k + 1} AS MATERIALIZED (SELECT g, i // 3 AS i, (max(size) + 2) // 3 AS size, sha256(string_agg(h, '' ORDER BY n.i)) AS h FROM {t}{k} n WHERE size > 1 GROUP BY g, n.i // 3)")
            ctes.append(
                f"{t}s{k} AS MATERIALIZED (SELECT a.g, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r "
                f"FROM {t}{k} a JOIN {t}{k} b ON a.g = b.g AND a.i // 3 = b.i // 3 WHERE a.size > 1 GROUP BY a.g, a.i)"
            )

    def climb(t: str, start: str, out: str, keep: str) -> None:
        """Folds both digests of each row of ``start`` up to the top of its group."""
        for k in range(depth):
            at = f"{start if k == 0 else f'{out}{k - 1}'}"
            ctes.append(
                f"{out}{k} AS (SELECT {keep}, x.g, x.i // 3 AS i, x.proof || coalesce(s.l || s.r, '') AS proof, CASE WHEN s.g IS NULL THEN x.fold ELSE sha256(s.l || x.fold || s.r) END AS fold "
                f"FROM {at} x LEFT JOIN {t}s{k} s ON x.g = s.g AND x.i = s.i)"
            )

    tree("n")
    tops = " UNION ALL ".join(f"SELECT g, h FROM n{k} WHERE size = 1" for k in range(depth + 1))
    ctes.append(f"tops AS MATERIALIZED ({tops})")
    ctes.append("m0 AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS size, h, g AS source FROM tops)")
    tree("m")
    roots = " UNION ALL ".join(f"SELECT h FROM m{k} WHERE size = 1" for k in range(depth + 1))
    ctes.append(f"root AS ({roots})")
    ctes.append("c AS (SELECT doc_id, h AS leaf, g AS source, g, i, '' AS proof, CASE WHEN crc % 2 = 0 THEN other ELSE h END AS fold FROM n0 JOIN crcs USING (doc_id))")
    climb("n", "c", "u", "doc_id, leaf, source")
    ctes.append(f"v AS (SELECT u.doc_id, u.leaf, u.source, '' AS g, m0.i, u.proof, u.fold FROM u{depth - 1} u JOIN m0 ON u.source = m0.source)")
    climb("m", "v", "w", "doc_id, leaf, source")
    ctes.insert(0, _CRC)
    return f"WITH {', '.join(ctes)} SELECT w.doc_id, w.leaf, tops.h AS subroot, root.h AS root, sha256(w.proof) AS proof_sha256, w.fold AS folded_root, w.fold = root.h AS verified FROM w{depth - 1} w JOIN tops ON w.source = tops.g, root"


SQL = _sql()
