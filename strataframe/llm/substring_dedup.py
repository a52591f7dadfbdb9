"""Removal of repeated passages: fixed-block anchors, every rolling window as a probe, hits extended to maximal repeats.

A passage is a window of ``LENGTH`` = 50 consecutive words of one document. Each word that is covered by a window which
also starts in a document with a smaller id goes.

1. *Index and probe.* Each document is cut into non-overlapping blocks of 25 words, and every rolling window of 25
   words probes them. Any 50 words hold a whole block, so two documents that share 50 words share a block of one that
   is a rolling window of the other. What travels is not one row for each rolling window: a window's *signature* is
   the least hash of the 8-word shingles in it, equal windows have equal signatures, and neighbouring windows mostly
   share theirs, so a probe row is a *run* of consecutive windows with one signature (about a tenth of the windows).
   A run that holds a block start is also the index entry of that block. A signature that some block has and that at
   least two documents have is a hit, for all its runs. Signatures only propose: equal ones need not be equal words.
2. *Extend.* A hit stands for the 50-word windows around its run, on both sides. Each such window is known by a
   BLAKE2b digest of its words' bytes (128 bits; no two different texts with one digest are known, nor can they be made
   at will as with polynomial hashes), the least document id of each digest is found, and the windows that have a
   smaller one are merged into the maximal repeats that are cut out.

Hot passages: within a batch of about 2 MB of text only the least document of a signature or a window goes on to the
shuffle, for the others are already decided (they have a smaller partner in the batch). Each task also remembers up to
``TOLD`` of the signatures and windows that several of its documents had, and doesn't send them again. So a passage that a third
of all documents hold is about a row for each task, not for each document, and no pair of documents is ever made.

Rows are dealt by id; if any id repeats, by id and a hash of the text, so that rows of one id are apart, each with its own windows.
Null ids are dealt by the hash of their texts.

Defined cases: a null or blank text has no words (``kept_sha256`` of the empty text); fewer than 50 words are never cut;
rows that repeat an id are one document for the comparison ("smaller" is strict), each with its own result; a row with a
null id is never cut and cuts no other; texts of any length are treated whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataframe.llm.shared import read

LENGTH, BLOCK, SHINGLE, BATCH_BYTES, TOLD = 50, 25, 8, 2_000_000, 1 << 18
U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and the powers of an odd base and of its inverse modulo 2**64, n at least."""
    if seed not in _POWERS or len(_POWERS[seed][1]) < n:
        base = int(_mixed(np.array([seed], U))[0]) & ~7 | 5
        size = max(n, BATCH_BYTES + BATCH_BYTES // 4)
        both = [np.cumprod(np.concatenate((np.ones(1, U), np.full(size - 1, x, U))), dtype=U) for x in (base, pow(base, -1, 1 << 64))]
        _POWERS[seed] = (_mixed(np.arange(1, 257, dtype=U) * U(2 * seed + 1)), *both)
    return _POWERS[seed]


class Batch:
    """Some documents' words as one buffer, with polynomial prefix hashes over its bytes modulo 2**64."""

    def __init__(self, texts: list[list[bytes]], seeds: tuple[int, ...]):
        self.n_words = np.array([len(t) for t in texts], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.n_words)[:-1])).astype(np.int64)
        words = [w for t in texts for w in t]
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.stop = np.cumsum(sizes)
        self.start = self.stop - sizes
        buf = np.frombuffer(b" ".join([*words, b""]), np.uint8)
        self.doc = np.repeat(np.arange(len(texts)), self.n_words)
        self.at = np.arange(len(words)) - np.repeat(self.first, self.n_words)
        self.left = np.repeat(self.n_words, self.n_words) - self.at
        self.prefix, self.inverse = [], []
        for seed in seeds:
            table, power, inverse = _powers(seed, len(buf) + 1)
            self.prefix.append(np.concatenate((np.zeros(1, U), np.cumsum(table[buf] * power[: len(buf)], dtype=U))))
            self.inverse.append(inverse)

    def hashes(self, begin: np.ndarray, width: int, k: int = 0) -> np.ndarray:
        """Of ``width`` words from each word index of ``begin``; the caller keeps windows inside documents."""
        i, j = self.start[begin], self.stop[np.minimum(begin + width - 1, len(self.stop) - 1)]
        return _mixed((self.prefix[k][j] - self.prefix[k][i]) * self.inverse[k][i])


def _batches(records: Iterator[pa.RecordBatch], wanted: str | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, list[list[bytes]], list]]:
    """(k, t, words, the column ``wanted``) of rows that can have windows, in batches of about BATCH_BYTES of text."""
    ks, ts, words, more, size = [], [], [], [], 0
    for record in records:
        columns = [record.column(c).to_pylist() for c in ("k", "doc_id", "text", *([wanted] if wanted else []))]
        apart = record.column("t").to_pylist() if "t" in record.schema.names else [0] * record.num_rows
        for t, k, doc_id, text, *other in zip(apart, *columns, strict=True):
            if doc_id is None or not text or wanted and not other[0]:
                continue
            own = text.encode().split()
            if len(own) < LENGTH:
                continue
            ks.append(k)
            ts.append(t)
            words.append(own)
            more += other
            size += len(text) + 64
            if size >= BATCH_BYTES:
                yield np.array(ks, np.int64), np.array(ts, np.int64), words, more
                ks, ts, words, more, size = [], [], [], [], 0
    if ks:
        yield np.array(ks, np.int64), np.array(ts, np.int64), words, more


def _group(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: where a new one begins, and the number of each row's group."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new, np.cumsum(new) - 1


class Told:
    """Sorted keys that a task has already sent on, TOLD at most."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, U)

    def has(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys

    def add(self, keys: np.ndarray) -> None:
        if len(keys) and len(self.keys) + len(keys) <= TOLD:
            self.keys = np.union1d(self.keys, keys)


def _runs(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, k, t, first, n, block, many, sure): runs of rolling windows; sure: a hit that the batch or the task has decided."""
    with_block, without = Told(), Told()
    for ids, ts, words, _ in _batches(records):
        b = Batch(words, (1,))
        least, width = b.hashes(np.arange(len(b.doc)), SHINGLE), 1
        for step in (1, 2, 4, 8, 2):  # 18 shingles to a window: 1 + 1 + 2 + 4 + 8 + 2
            least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
            width += step
        assert width == BLOCK - SHINGLE + 1
        ok = np.flatnonzero(b.left[: len(least)] >= BLOCK)
        sig, doc, at = least[ok], b.doc[ok], b.at[ok]
        head = np.flatnonzero(_group(sig, doc)[0])
        n = np.diff(np.append(head, len(sig)))
        sig, doc, at = sig[head], doc[head], at[head]
        block = (at + n - 1) // BLOCK * BLOCK >= at
        order = np.lexsort((at, ids[doc], sig))
        sig, doc, at, n, block = sig[order], doc[order], at[order], n[order], block[order]
        new, g = _group(sig)
        starts = np.flatnonzero(new)
        of = ids[doc]
        several = of[new] != np.maximum.reduceat(of, starts)
        blocks = np.maximum.reduceat(block.astype(np.int8), starts) > 0
        told = with_block.has(sig[new])
        known = told | ~blocks & without.has(sig[new])  # another batch of this task has said as much
        decided = (several | known)[g]
        first = _group(sig, of)[0]
        # The first row of a new group of several speaks for all, and so does a document's first run with a signature for those that follow.
        say = np.flatnonzero(~decided & first | new & ~known[g])
        sure = np.flatnonzero(decided | ~first)
        with_block.add(sig[new][several & blocks & ~told])
        without.add(sig[new][several & ~blocks & ~known])
        for idx, settled in ((say, False), (sure[np.lexsort((at[sure], doc[sure]))], True)):
            if len(idx):
                key = _mixed(of[idx].view(U) ^ ts[doc[idx]].view(U)) if settled else sig[idx]  # what is settled may go to any task
                no = np.zeros(len(idx), bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(of[idx]), pa.array(ts[doc[idx]]), pa.array(at[idx].astype(np.int32)), pa.array(n[idx].astype(np.int32)), pa.array(no if settled else blocks[g[idx]]), pa.array(no if settled else several[g[idx]]), pa.array(no | settled)],
                    ["sig", "k", "t", "first", "n", "block", "many", "sure"],
                )


def _digests(words: list[list[bytes]], b: Batch, begin: np.ndarray) -> list[bytes]:
    """For each window of LENGTH words the BLAKE2b digest of its words with one blank between them."""
    line, digest = b" ".join([w for t in words for w in t]), hashlib.blake2b
    i, j = b.start[begin].tolist(), (b.stop[begin + LENGTH - 1] - 1).tolist()
    return [digest(line[x:y], digest_size=16).digest() for x, y in zip(i, j, strict=True)]


def _spans(packed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """first and n of runs packed as first * 2**32 + n."""
    x = np.array(packed, np.int64)
    return x >> 32, x & 0xFFFFFFFF


def _windows(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, k, t, first, n, more, sure): the 50-word windows around hits, each of a document once, with its other places in ``more``.

    sure: n windows in a row that have a smaller partner in the batch or the task.
    """
    told: dict[bytes, int] = {}
    for ids, ts, words, runs in _batches(records, "runs"):
        b = Batch(words, ())
        here = np.zeros(len(b.doc) + 1, np.int64)
        for d, (own, hits) in enumerate(zip(words, runs, strict=True)):
            begin, n = _spans(hits)
            end = np.minimum(begin + n - 1, len(own) - LENGTH)
            begin = np.maximum(begin - (LENGTH - BLOCK), 0)
            fit = begin <= end
            np.add.at(here, begin[fit] + b.first[d], 1)
            np.add.at(here, end[fit] + 1 + b.first[d], -1)
        start = np.flatnonzero(np.cumsum(here[:-1]) > 0)
        if not len(start):
            continue
        raw = _digests(words, b, start)
        h = np.frombuffer(b"".join(raw), U).reshape(-1, 2)
        order = np.lexsort((start, b.doc[start], ids[b.doc[start]], h[:, 1], h[:, 0]))
        s, h = start[order], h[order]
        d = b.doc[s]
        of = ids[d]
        new, g = _group(h[:, 0], h[:, 1])
        heads = np.flatnonzero(new)
        low = of[heads]
        several = np.flatnonzero(low != np.maximum.reduceat(of, heads))
        if told:
            low = np.minimum(low, np.array([told.get(raw[x], 2**63 - 1) for x in order[heads].tolist()], np.int64))
        for x in several.tolist() if len(told) + len(several) <= TOLD else ():
            told[raw[order[heads[x]]]] = int(low[x])
        sure = of > low[g]
        # Decided windows go on as runs.
        at = np.sort(s[sure])
        if len(at):
            head = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (b.doc[at[1:]] != b.doc[at[:-1]]))))
            n, at = np.diff(np.append(head, len(at))), at[head]
            own = b.doc[at]
            key = _mixed(ids[own].view(U) ^ ts[own].view(U))  # to any task
            yield _window_rows(key, np.zeros(len(at), U), ids[own], ts[own], b.at[at], n, None, True)
        # Of the others each is sent once for a document.
        s, h, d, of = s[~sure], h[~sure], d[~sure], of[~sure]
        if len(s):
            first = _group(h[:, 0], h[:, 1], d)[0]
            head, rest = np.flatnonzero(first), np.flatnonzero(~first)
            many = np.diff(np.append(head, len(s))) - 1
            more = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32)), pa.array(b.at[s[rest]].astype(np.int32)), mask=pa.array(many == 0))
            by_page = pa.array(np.argsort(s[head]))
            yield _window_rows(h[head, 0], h[head, 1], of[head], ts[d[head]], b.at[s[head]], np.ones(len(head), np.int64), more, False).take(by_page)


def _window_rows(h1: np.ndarray, h2: np.ndarray, k: np.ndarray, t: np.ndarray, first: np.ndarray, n: np.ndarray, more: pa.Array | None, sure: bool) -> pa.RecordBatch:
    more = pa.nulls(len(k), pa.list_(pa.int32())) if more is None else more
    columns = [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(k), pa.array(t), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), more, pa.array(np.full(len(k), sure))]
    return pa.RecordBatch.from_arrays(columns, ["h1", "h2", "k", "t", "first", "n", "more", "sure"])


def _cut(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for record in records:
        out = []
        for doc_id, text, starts, more in zip(*(record.column(c).to_pylist() for c in ("doc_id", "text", "starts", "more")), strict=True):
            words = (text or "").encode().split()
            n, gone = len(words), 0
            if starts and doc_id is not None:
                here = np.zeros(n + 1, np.int64)
                first, many = _spans(starts + [x << 32 | 1 for x in more])
                np.add.at(here, first, 1)
                np.add.at(here, first + many + LENGTH - 1, -1)
                keep = np.cumsum(here[:-1]) == 0
                words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                gone = n - len(words)
            kept = b" ".join(words)
            out.append((doc_id, n, gone, hashlib.sha256(kept).hexdigest(), kept.decode()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def _cut_digest(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut(records):
        yield batch.select(["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeats(docs: DataFrame) -> DataFrame:
    """(k, t, starts, more): of each row with repeats, the windows that a smaller id has too: runs of first words (packed) and single ones.

    ``docs`` has k, doc_id, text and, if ids repeat, t, dealt by k and t; the exchange is read once for all its uses.
    """
    keys = [c for c in ("k", "t") if c in docs.columns]
    packed = F.col("first").cast("long") * (1 << 32) + F.col("n")
    runs = docs.mapInArrow(_runs, "sig long, k long, t long, first int, n int, block boolean, many boolean, sure boolean")
    same = Window.partitionBy("sig")
    hits = (
        runs.withColumns({"low": F.min("k").over(same), "high": F.max("k").over(same), "blocks": F.max("block").over(same), "two": F.max("many").over(same)})
        .where("sure or (blocks and (two or low <> high))")
        .groupBy(*keys)
        .agg(F.collect_list(packed).alias("runs"))
    )
    # A left join, so that no filter sets this use of the exchange apart; texts without hits don't go to Python.
    near = docs.join(hits, keys, "left").select(*keys, "doc_id", F.when(F.col("runs").isNotNull(), F.col("text")).alias("text"), "runs")
    windows = near.mapInArrow(_windows, "h1 long, h2 long, k long, t long, first int, n int, more array<int>, sure boolean")
    same = Window.partitionBy("h1", "h2")
    return windows.withColumn("low", F.min("k").over(same)).where("sure or low < k").groupBy(*keys).agg(F.collect_list(packed).alias("starts"), F.flatten(F.collect_list("more")).alias("more"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, kept_text: one row for each row of ``docs``."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # The rows of one id are told apart by their texts, but only if some id has several rows: for most tables that is nothing to send.
    alone = own.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).isEmpty()
    text_key = F.xxhash64(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    keys = {"k": F.coalesce("doc_id", text_key)} | ({} if alone else {"t": text_key})
    dealt = own.select(*(c.alias(k) for k, c in keys.items()), "doc_id", "text").repartition(*keys)
    joined = dealt.join(repeats(dealt), list(keys), "left").select("doc_id", "text", "starts", "more")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return joined.mapInArrow(_cut, schema + ", kept_text string") if texts else joined.mapInArrow(_cut_digest, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read(spark, sf_dir, "documents"), texts=False)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
a AS MATERIALIZED (SELECT r, doc_id, unnest(range(1, len(ws) - 48)) AS k, ws FROM d WHERE doc_id IS NOT NULL AND len(ws) >= 50),
s AS MATERIALIZED (SELECT r, doc_id, k, array_to_string(ws[k : k + 49], ' ') AS win FROM a),
m AS (SELECT win, min(doc_id) AS least FROM s GROUP BY win HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT r, unnest(range(k, k + 50)) AS i FROM s JOIN m USING (win) WHERE least < doc_id),
w AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
k AS (SELECT w.r, string_agg(w.word, ' ' ORDER BY w.i) FILTER (WHERE g.i IS NULL) AS kept, count(g.i) AS n_removed FROM w LEFT JOIN g ON w.r = g.r AND w.i = g.i GROUP BY w.r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.r = k.r
"""
