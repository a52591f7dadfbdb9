"""Best-fit packing of documents into sequences by linear grouping of a length histogram.

Documents become pieces of at most ``CAPACITY`` tokens. A plan is made from the *histogram* of piece lengths alone, at most
``CAPACITY`` counts whatever the corpus holds: lengths over an eighth of a sequence are rounded up within ``GROUPS`` groups of
equal cardinality; configurations of those few sizes are optimised (the linear programme of the cutting-stock problem, by
column generation); actual lengths take the places of the rounded ones; what is left of a sequence, and the small lengths, are
filled by best fit, the longest first. The plan is a list of rules "pieces of length s with ranks from r on, n of them, go to
sequences from q on at offset o", which each piece looks up with its rank among the pieces of its length. Ranks are counted
within buckets of at most a 256th of all pieces, so a length that a third of the pieces have is no hot key.

Defined cases: a null or empty text is the end token alone; a document longer than a sequence is cut so that only its first
piece may be shorter; a repeated row is packed again; null ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataframe.llm.shared import read, stored

CAPACITY, END, GROUPS, SMALL, CACHE = 1024, 2, 100, 128, 400_000
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, equal to those of the tokenizer's file.

    Where every white space is one blank or line feed between other characters, the pre-tokenizer always splits before the
    blank and on both sides of the line feed, so such texts are encoded word by word, from a bounded cache. All others, and
    those with the special token's string, go through the tokenizer as a whole.
    """

    def __init__(self, folder: str | None = None):
        import base64
        import os

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = (lambda name: os.path.join(folder, name)) if folder else public_tokenizers.path
        self.whole = Tokenizer.from_file(path(TOKENIZER))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(path(RANKS), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ordinary = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cache: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        if len(self.cache) >= CACHE:
            self.cache.clear()
        ids = self.cache[word] = np.array(self.ordinary(word if word[:1] == "\n" else " " + word), "<u4").tobytes()
        return ids

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if text.split() == text.replace("\n", " ").split(" ") and not any(s in text for s in self.special):
            words, known = text.replace("\n", " \n").split(" "), self.cache.get
            first = np.array(self.ordinary(words[0]), "<u4").tobytes()
            return first + b"".join([known(w) or self.word(w) for w in words[1:]])
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(folder: str | None = None) -> Encoder:
    if folder not in _ENCODERS:
        _ENCODERS[folder] = Encoder(folder)
    return _ENCODERS[folder]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, folder: str | None = None, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, with ``ids``, the token ids of each piece."""
    last = np.array([end], "<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder)
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = encode(text.as_py() or "") + last
                n = len(data) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = data[4 * i : 4 * j]
                    for column, x in zip(out, (doc_id, k, i, j - i, zlib.crc32(part), np.frombuffer(part, "<u4") if ids else None), strict=True):
                        column.append(x)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)][: 5 + ids], names[: 5 + ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(rows, schema)


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """(how many of each size, how often): a basic optimal solution of the cutting-stock linear programme."""
    k = len(sizes)
    size = np.array(sizes)
    columns = [np.eye(k)[i] * (capacity // sizes[i]) for i in range(k)]
    inverse = np.diag([1 / (capacity // s) for s in sizes])
    x = inverse @ np.array(demand, float)
    for _ in range(40 * k):
        price = inverse.sum(axis=0)
        worth, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(1, capacity + 1):  # the best filled sequence at these prices
            fit = np.searchsorted(size, room, "right")
            worth[room], pick[room] = worth[room - 1], -1
            if fit:
                got = worth[room - size[:fit]] + price[:fit]
                if got[j := int(got.argmax())] > worth[room] + 1e-12:
                    worth[room], pick[room] = got[j], j
        if worth[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        while room > 0:
            if pick[room] < 0:
                room -= 1
            else:
                column[pick[room]] += 1
                room -= size[pick[room]]
        way = inverse @ column
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        row = int(ratio.argmin())
        x -= ratio[row] * way
        x[row] = ratio[row]
        columns[row] = column
        inverse[row] /= way[row]
        others = np.arange(k) != row
        inverse[others] -= np.outer(way[others], inverse[row])
    else:
        warnings.warn(f"the packing programme of {k} sizes was left before its optimum; the plan is whole, but may be less tight", stacklevel=2)
    return [(c, max(0.0, v)) for c, v in zip(columns, x, strict=True)]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> tuple[np.ndarray, int]:
    """Rules (length, first rank, number, first sequence, offset), and the number of sequences."""
    rules: list[tuple[int, int, int, int, int]] = []
    used = dict.fromkeys(counts, 0)
    top = 0
    if full := counts.get(capacity, 0):
        rules.append((capacity, 0, full, 0, 0))
        top = used[capacity] = full
    large = sorted(s for s in counts if small < s < capacity)
    rooms: dict[int, list[tuple[int, int]]] = {}  # what is free: (first sequence, how many)

    def place(s: int, n: int, sequence: int, offset: int) -> None:
        rules.append((s, used[s], n, sequence, offset))
        used[s] += n

    if large:
        total, queues, sizes, demand, seen = sum(counts[s] for s in large), [], [], [], 0
        share = total / groups
        for s in large:  # equal cardinality: a length may lie in several groups
            left = counts[s]
            while left:
                g = min(groups - 1, int(seen / share + 1e-9))
                n = left if g == groups - 1 else min(left, max(1, int(np.ceil((g + 1) * share - seen))))
                if len(queues) and queues[-1][0] == g:
                    queues[-1][1].append([s, n])
                else:
                    queues.append((g, [[s, n]]))
                left -= n
                seen += n
        merged: dict[int, list[list[int]]] = {}
        for _, q in queues:  # groups of one rounded length are one size of the programme
            merged.setdefault(q[-1][0], []).extend(q)
        sizes = sorted(merged)
        demand = [sum(n for _, n in merged[s]) for s in sizes]
        queue = [sorted(merged[s], reverse=True) for s in sizes]

        def take(i: int, n: int) -> list[list[int]]:
            """The next n actual lengths of a group, the longest first."""
            out = []
            while n and queue[i]:
                m = min(n, queue[i][0][1])
                out.append([queue[i][0][0], m])
                queue[i][0][1] -= m
                n -= m
                if not queue[i][0][1]:
                    queue[i].pop(0)
            return out

        for column, often in configurations(sizes, demand, capacity):
            n = int(often + 1e-6)
            places = [i for i in range(len(sizes)) for _ in range(int(column[i]))]
            n = min([n, *(sum(m for _, m in queue[i]) // places.count(i) for i in set(places))]) if places else 0
            if not n:
                continue
            taken = [take(i, n) for i in sorted(places, reverse=True)]
            done = 0
            while done < n:  # as far as the actual lengths stay the same
                m = min(t[0][1] for t in taken)
                offset = 0
                for t in taken:
                    place(t[0][0], m, top + done, offset)
                    offset += t[0][0]
                    t[0][1] -= m
                    if not t[0][1]:
                        t.pop(0)
                if offset < capacity:
                    rooms.setdefault(capacity - offset, []).append((top + done, m))
                done += m
            top += n
    free = sorted(rooms)
    for s in sorted((s for s in counts if counts[s] > used[s]), reverse=True):
        left = counts[s] - used[s]
        while left:
            k = bisect.bisect_left(free, s)
            if k == len(free):
                each = capacity // s
                n, m = (left // each, each) if left >= each else (1, left)
                for j in range(m):
                    place(s, n, top, j * s)
                rest, first, left = capacity - m * s, top, left - n * m
                top += n
            else:
                room = free[k]
                first, there = rooms[room].pop()
                n = min(left, there)
                place(s, n, first, capacity - room)
                if n < there:
                    rooms[room].append((first + n, there - n))
                if not rooms[room]:
                    del rooms[room]
                    free.pop(k)
                rest, left = room - s, left - n
            if rest:
                if rest not in rooms:
                    rooms[rest] = []
                    bisect.insort(free, rest)
                rooms[rest].append((first, n))
    return np.array(sorted(rules), np.int64).reshape(-1, 5), top


def packed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (written once: it is read three times)."""
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    rules, _ = plan(counts, capacity)
    total = max(1, sum(counts.values()))
    buckets = F.array(*[F.lit(max(1, -(-counts.get(s, 0) // 100_000), -(-256 * counts.get(s, 0) // total))) for s in range(capacity + 1)])
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in parts.columns]  # repeated and null ids differ in the last
    held = parts.withColumn("bucket", F.pmod(F.xxhash64(*order), F.element_at(buckets, F.col("length").cast("int") + 1)))
    before = (
        held.groupBy("length", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    )
    ranked = held.withColumn("own", F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order)) - 1).join(before, ["length", "bucket"])
    columns = parts.columns

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (rules[:, 0] << 44) + rules[:, 1]
        for b in batches:
            rank = b.column("rank").to_numpy()
            rule = rules[np.searchsorted(key, (b.column("length").to_numpy() << 44) + rank, "right") - 1]
            own = [b.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*own, pa.array(rule[:, 3] + rank - rule[:, 1]), pa.array(rule[:, 4])], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    return ranked.select(*columns, (F.col("before") + F.col("own")).alias("rank")).mapInArrow(look_up, schema)


def pack(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece."""
    return packed(stored(pieces(docs, folder=folder, id_col=id_col, text_col=text_col), "pieces"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
