"""Exact top-k inner products by KD-trees, one for each shard of the vectors.

Vectors are dealt by the top of one KD-tree: median splits of a sample of at most ``SAMPLE`` vectors (any splits give the same results)
down to leaves of about ``SHARD`` vectors; a leaf that holds more, as of many equal vectors, is dealt on by a hash, so a shard has about
``SHARD`` vectors whatever they are. Each shard's own tree splits at the median of the widest side
down to leaves of ``LEAF``, and every node has the tight box of its vectors. A query walks a tree best first: the largest inner
product that a box allows, sum of max(q*low, q*high), orders the nodes, and a node whose bound is below the k-th best score
found so far is never opened, nor any after it (a bound that equals it is, for a tie may have a smaller id). First each query
walks one shard, its home; the k-th score it has there is then propagated to all other shards as the bound to start from. A query is
sent only to shards whose box reaches that bound, as long as there are at most ``BOXES`` shards, whose boxes are broadcast; with more of them it
is sent to all, and each shard's own root decides.

Queries are a stated set (ids divisible by ``EVERY``). Shards stream: a task has one shard's vectors, whose tree it builds once, and
then reads that shard's queries batch by batch; it returns at most k rows for each, so that the last merge has k rows for a shard and query.

Defined cases: a component x becomes floor(1024 * x); vectors that are null, empty or hold a null or non-finite component take
no part; only vectors of the query's own length are candidates; the query's own id is none. Every other row is a candidate: rows that
repeat an id and a vector travel once with their number and each take a place in the result, as do different vectors of one id. As a
query each distinct vector of an id asks once, and the best k of all are given. A null id
takes no part; fewer than k candidates give all of them; an empty table gives an empty result; if a score might not fit 64 bits, an error
says so before anything is searched.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataframe.llm.shared import few, least_hashed, read, stored

K, EVERY, SCALE, SHARD, LEAF, SAMPLE, BOXES = 10, 100, 1024, 8192, 64, 20_000, 4096


class Tree:
    """Median splits with tight boxes; rows are reordered so that each leaf is a slice."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.lexsort((ids,))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.span: list[tuple[int, int]] = []
        self.child: list[tuple[int, int] | None] = []
        todo = [(0, len(order), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            own = points[order[a:b]]
            low, high = own.min(axis=0), own.max(axis=0)
            me = len(self.span)
            self.low.append(low)
            self.high.append(high)
            self.span.append((a, b))
            self.child.append(None)
            if parent >= 0:
                self.child[parent] = (me, -1) if side == 0 else (self.child[parent][0], me)
            axis = int((high - low).argmax())
            if b - a > leaf and high[axis] > low[axis]:
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, axis], half)]
                todo += [(a + half, b, me, 1), (a, a + half, me, 0)]
        self.order, self.ids, self.points = order, ids[order], points[order]

    def bound(self, q: np.ndarray, node: int) -> int:
        return int(np.maximum(q * self.low[node], q * self.high[node]).sum())

    def top(self, q: np.ndarray, own: int, k: int, least: int | None = None) -> list[tuple[int, int]]:
        """At most k (score, row), best first, of those that reach ``least``; ties go to smaller ids."""
        best: list[tuple[int, int, int]] = []  # a heap of (score, -id, -row): the worst is first
        queue = [(-self.bound(q, 0), 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            floor = best[0][0] if len(best) == k else least
            if least is not None and floor < least:
                floor = least
            if floor is not None and -bound < floor:
                break
            if self.child[node]:
                for c in self.child[node]:
                    heapq.heappush(queue, (-self.bound(q, c), c))
                continue
            a, b = self.span[node]
            score = self.points[a:b] @ q
            fit = self.ids[a:b] != own
            if floor is not None:
                fit &= score >= floor
            for row in (np.flatnonzero(fit) + a).tolist():
                entry = (int(score[row - a]), -int(self.ids[row]), -row)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return [(s, -row) for s, _, row in sorted(best, reverse=True)]


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """The vectors of a list column, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (dim, shard, asks, vec_id, v, n, least), of each shard its vectors first, then its queries."""
    now, held, tree, counts = None, [], None, None
    for batch in batches:
        out: list[tuple[int, int, int, int]] = []
        keys = list(zip(batch.column("dim").to_pylist(), batch.column("shard").to_pylist(), batch.column("asks").to_pylist(), strict=True))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            part = batch.slice(i, j - i)
            if keys[i][:2] != now:
                now, held, tree = keys[i][:2], [], None
            if not keys[i][2]:
                held.append((part.column("vec_id").to_numpy(), _matrix(part.column("v"), now[0]), part.column("n").to_numpy()))
                continue
            if not held:
                continue
            if tree is None:
                ids, points, n = (np.concatenate(x) for x in zip(*held, strict=True))
                tree = Tree(ids, points)
                counts = n[tree.order]
            for query_id, q, least in zip(part.column("vec_id").to_pylist(), _matrix(part.column("v"), now[0]), part.column("least").to_pylist(), strict=True):
                out += [(query_id, int(tree.ids[row]), s, int(counts[row])) for s, row in tree.top(q, query_id, k, least)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], ["query_id", "vec_id", "score", "n"])


def _splits(sample: np.ndarray, leaves: int) -> list[tuple[int, int, int, int]]:
    """Median splits of a sample: (side, value, node below, node from it on); a leaf is (-1, its number, 0, 0)."""
    nodes: list[tuple[int, int, int, int]] = []
    size = max(1, -(-len(sample) // leaves))

    def split(rows: np.ndarray) -> int:
        me = len(nodes)
        nodes.append((-1, 0, 0, 0))
        if len(rows) > size:
            axis = int((rows.max(axis=0) - rows.min(axis=0)).argmax())
            value = int(np.median(rows[:, axis]))
            low = rows[:, axis] < value
            if low.any() and not low.all():
                a = split(rows[low])
                nodes[me] = (axis, value, a, split(rows[~low]))
        return me

    if len(sample):
        split(sample)
    leaf = 0
    for k, n in enumerate(nodes):
        if n[0] < 0:
            nodes[k] = (-1, leaf, 0, 0)
            leaf += 1
    return nodes


def _leaves(points: np.ndarray, nodes: list[tuple[int, int, int, int]]) -> np.ndarray:
    """The leaf of each vector."""
    out = np.zeros(len(points), np.int32)
    todo = [(0, np.arange(len(points)))] if nodes else []
    while todo:
        node, rows = todo.pop()
        axis, value, low, high = nodes[node]
        if axis < 0:
            out[rows] = value
        elif len(rows):
            below = points[rows, axis] < value
            todo += [(low, rows[below]), (high, rows[~below])]
    return out


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products of integer vectors."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    usable = stored(
        vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0))
        .where(~bad)
        .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))
        .groupBy("vec_id", "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("dim", F.size("v")),
        "vectors",
    )
    largest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))
    kinds = {r["dim"]: r for r in usable.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), largest.alias("largest")).collect()}  # a row for each length of vectors
    for dim, r in kinds.items():
        if r["largest"] ** 2 * dim >= 2.0**63:
            raise OverflowError(f"inner products of vectors of length {dim} may not fit 64 bits")
    tops = {}
    for dim, r in kinds.items():
        some = least_hashed(usable.where(F.col("dim") == dim), F.xxhash64("vec_id", "v"), SAMPLE // 2).select("v").limit(SAMPLE).toArrow()
        tops[dim] = _splits(_matrix(some.column("v").combine_chunks(), dim), max(1, min(some.num_rows // 8, -(-r["n"] // SHARD))))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, out = b.column("dim").to_numpy(), np.zeros(b.num_rows, np.int32)
            for dim in set(dims.tolist()):
                rows = np.flatnonzero(dims == dim)
                out[rows] = _leaves(_matrix(b.column("v").take(pa.array(rows)), dim), tops[dim])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "leaf"])

    placed = stored(usable.select("dim", "vec_id", "v", "n").mapInArrow(leaves, "dim int, vec_id long, v array<long>, n long, leaf int"), "placed")
    # Leaves that hold more are dealt on: (first shard, shards) of each leaf, at most some for each SHARD vectors.
    sizes = placed.groupBy("dim", "leaf").agg(F.count(F.lit(1)).alias("rows")).withColumn("parts", F.ceil(F.col("rows") / SHARD).cast("int"))
    before = F.sum("parts").over(Window.partitionBy("dim").orderBy("leaf")) - F.col("parts")
    sizes = stored(sizes.withColumn("first", before.cast("int")).select("dim", "leaf", "first", "parts"), "leaves")
    shard = (F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))).cast("int")
    dealt = placed.join(F.broadcast(sizes) if few(sizes) else sizes, ["dim", "leaf"]).select("dim", shard.alias("shard"), "vec_id", "v", "n")
    queries = dealt.where(F.col("vec_id") % every == 0)
    totals = {r["dim"]: r["n"] for r in sizes.groupBy("dim").agg(F.sum("parts").alias("n")).collect()}
    none = F.lit(None).cast("long").alias("least")

    def searched(asking: DataFrame) -> DataFrame:
        rows = dealt.select("dim", "shard", F.lit(False).alias("asks"), "vec_id", "v", "n", none).unionByName(asking.select("dim", "shard", F.lit(True).alias("asks"), "vec_id", "v", F.lit(0).cast("long").alias("n"), "least"))
        return rows.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "asks").mapInArrow(lambda b: _search(b, k), "query_id long, vec_id long, score long, n long")

    at_home = stored(searched(queries.withColumn("least", F.lit(None).cast("long"))), "home")
    kth = _best(at_home, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    asking = queries.join(kth, "vec_id", "left").select("dim", "vec_id", "v", "least", F.col("shard").alias("home"))
    count = F.element_at(F.create_map(*(F.lit(x) for pair in totals.items() for x in pair)), F.col("dim")) if totals else F.lit(1)
    boxes = None
    if sum(totals.values()) <= BOXES:
        each = dealt.select("dim", "shard", F.posexplode("v").alias("at", "x")).groupBy("dim", "shard", "at").agg(F.min("x").alias("low"), F.max("x").alias("high"))
        sides = each.groupBy("dim", "shard").agg(F.array_sort(F.collect_list(F.struct("at", "low", "high"))).alias("box")).collect()  # BOXES rows at most
        boxes = {dim: ([r["shard"] for r in sides if r["dim"] == dim], np.array([[(x["low"], x["high"]) for x in r["box"]] for r in sides if r["dim"] == dim], np.int64)) for dim in totals}

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, shards = [], []
            for i, (dim, q, least, home) in enumerate(zip(*(b.column(c).to_pylist() for c in ("dim", "v", "least", "home")), strict=True)):
                names, box = boxes[dim]
                x = np.array(q, np.int64)
                bound = np.maximum(box[:, :, 0] * x, box[:, :, 1] * x).sum(axis=1)
                hit = [s for s, ok in zip(names, (bound >= least if least is not None else bound == bound).tolist(), strict=True) if ok and s != home]
                rows += [i] * len(hit)
                shards += hit
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("dim").take(at), pa.array(shards, pa.int32()), b.column("vec_id").take(at), b.column("v").take(at), b.column("least").take(at)], ["dim", "shard", "vec_id", "v", "least"])

    if boxes is None:
        sent = asking.withColumn("shard", F.explode(F.sequence(F.lit(0), count.cast("int") - 1))).where("shard <> home")
    else:
        sent = asking.mapInArrow(reached, "dim int, shard int, vec_id long, v array<long>, least long")
    found = _best(at_home.union(searched(sent)), k).drop("rank")
    rows = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k)))))
    return _best(rows, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 100 = 0) q JOIN v c ON c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
