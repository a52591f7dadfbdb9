"""SentencePiece encoding and decoding as a relational lattice.

A text becomes words that no piece of the model crosses: marks (the model's sign of a blank) with the run of letters after them, or with one
run of other characters; line feeds stand alone. Where a piece could cross such a cut is read off the piece table, and a model that
has one is refused. Of each *different* word

1. all substrings of at most the longest piece's length are exploded,
2. they are joined with the piece table (broadcast; its size is the model's, and checked), which leaves the lattice's edges,
3. edges are grouped by word, and
4. one ``aggregate`` folds them, in the order of the edges' ranks, over a bit mask of the boundaries that are left.

The model at hand is a byte-pair model, for which the path with the best sum of scores (plain Viterbi) is another segmentation for more than
half of all words. So the fold takes the best edge first: an edge is taken if both its ends are boundaries and one boundary lies between them,
which it removes. One pass in the order of ranks is exact because what happens between two boundaries that stay
depends on nothing outside them: a piece is made when the piece's own string would be, so its *order* (the merge that makes it possible,
the place of that merge, and the steps after it) is worked out once for each piece, by :func:`orders`. Pieces that merges never make have no edge.

Each different word is folded once. The commonest words of a bounded sample of documents (at most ``KNOWN``; any choice gives the same ids)
are broadcast to the workers, where texts are split and their words looked up in Arrow batches. What they don't cover is dealt once, as (word, text's digest), by the word, and
folded there, in tasks of the words that ``SHARE`` bytes of text miss, grouped in memory; ids, of two bytes each, go back to the digest. They meet the texts there, which move once, as
the compressed numbers of their words. No text moves as such. A word that many texts share is in the sample but for
vanishing odds (texts are drawn by their digest, copies as one); a text's digest is salted by its document's id, so copies are dealt evenly, and should two texts share one, each finds its own words by their spelling.
Words over ``SHORT`` characters don't fit the mask; their lattices are folded in the last step with a heap.

Decoding explodes ids, joins them with the piece table and puts the bytes together.

Defined cases: a null or empty text has no ids; a character without a piece becomes its UTF-8 bytes' pieces; rows that repeat an id are
encoded each; null ids are kept; decoding gives the text back (a literal mark comes back as a blank); null ids of a token table give null.
"""

from __future__ import annotations

import hashlib
import heapq
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm.shared import least_hashed, read, removed, salt, stored

MARK, MODEL, SHORT, SAMPLE, KNOWN, PIECES, TASK, BLOCK = "▁", "piece_bpe_32k.model", 60, 40_000, 500_000, 1_000_000, 20_000, 100_000
#: Bytes of text whose missing words make a task of the fold; words of a task that are grouped without a sort.
SHARE, GROUPED = 4_000_000, 50_000
#: Kinds of characters, and whether a word begins at one of the second kind after one of the first: marks go with a run of letters or of others, line feeds alone.
OTHER, LETTER, BLANK, FEED = range(4)
BEGINS = np.array([FEED in (a, b) or (b == BLANK or a != BLANK) and a != b for a in range(4) for b in range(4)])
#: Bytes of text that are split at once and that are looked up at once.
SPLIT, PART = 2_000_000, 8_000_000


def _letter(c: str) -> bool:
    return unicodedata.category(c)[0] == "L"


def orders(scores: dict[str, float]) -> dict[str, tuple[int, int, int]]:
    """When merges make each piece of two characters or more: (rank, place, step) of the merge that makes it possible and of what follows at once."""
    rank = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
    out = {}
    for piece in scores:
        parts, last, step = list(piece), (-1, -1), 0
        while len(parts) > 1:
            pairs = [(rank[scores[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in scores]
            if not pairs:
                break
            r, k = min(pairs)
            place = sum(map(len, parts[:k]))
            last, step = ((r, place), 0) if (r, place) > last else (last, step + 1)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if len(piece) > 1 and len(parts) == 1:
            out[piece] = (*last, step)
    return out


class Codec:
    """The model's tables, and the fold of words that are too long for a mask."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))
        n = self.model.get_piece_size()
        special = [self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i) for i in range(n)]
        self.pieces = {self.model.id_to_piece(i): i for i in range(n) if not special[i]}
        self.scores = {p: self.model.get_score(i) for p, i in self.pieces.items()}
        self.byte_ids = {int(self.model.id_to_piece(i)[3:5], 16): i for i in range(n) if self.model.is_byte(i)}
        self.longest = max(map(len, self.pieces))
        if len(self.pieces) >= 1 << 16 or self.byte_ids != {b: self.byte_ids[0] + b for b in range(256)}:
            raise ValueError("ids must fit 16 bits, and those of bytes follow each other")
        said = {i: p.replace(MARK, " ").encode() for p, i in self.pieces.items()} | {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.said = [said.get(i, b"") for i in range(n)]
        for p in self.pieces:
            for a, b in zip(p, p[1:], strict=False):
                if "\n" in (a, b) or b == MARK != a or a != MARK and _letter(a) != _letter(b):
                    raise ValueError(f"the piece {p!r} crosses words")

    @cached_property
    def orders(self) -> dict[str, tuple[int, int, int]]:
        return orders(self.scores)

    def ids_of(self, word: str) -> list[int]:
        """The ids of a word of any length: the same edges, taken from a heap."""
        n, edges = len(word), {}
        for i in range(n):
            for j in range(i + 2, min(n, i + self.longest) + 1):
                if found := self.orders.get(word[i:j]):
                    edges[i, j] = (-self.scores[word[i:j]], i)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        todo = [(edges[i, i + 2], i, i + 1, i + 2) for i in range(n - 1) if (i, i + 2) in edges]
        heapq.heapify(todo)
        while todo:
            _, i, middle, j = heapq.heappop(todo)
            if not (alive[i] and after[i] == middle and middle < n and alive[middle] and after[middle] == j):
                continue
            alive[middle] = False
            after[i] = j
            if j < n:
                before[j] = i
                if (i, after[j]) in edges:
                    heapq.heappush(todo, (edges[i, after[j]], i, j, after[j]))
            if (p := before[i]) >= 0 and (p, j) in edges:
                heapq.heappush(todo, (edges[p, j], p, i, j))
        ids: list[int] = []
        for part in (word[i : after[i]] for i in range(n) if alive[i]):
            found = self.pieces.get(part)
            ids += [found] if found is not None else [self.byte_ids[b] for b in part.encode()]
        return ids

    def word_of(self, data: bytes) -> bytes:
        """The word, with blanks for its marks, that ids of two bytes spell."""
        return b"".join([self.said[i] for i in np.frombuffer(data, "<u2").tolist()])

    @staticmethod
    def text_of(said: bytes) -> str:
        text = said.decode(errors="replace")
        return text[1:] if text[:1] == " " else text


_CODECS: dict[str | None, Codec] = {}


def codec(path: str | None = None) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def piece_table(spark: SparkSession, c: Codec, width: int) -> DataFrame:
    """part, said (its id as hex digits), order (rank, place below 2**7, step below 2**5), and the masks of its ends and of what lies between them."""
    if len(c.pieces) > PIECES:
        raise ValueError("the piece table is too large for a broadcast")
    rows = []
    for p, i in c.pieces.items():
        rank, place, step = c.orders.get(p, (0, 0, 0))
        if len(p) == 1 or p in c.orders:
            rows.append((p, _hex(i, width), rank << 12 | place << 5 | step, 1 << len(p) | 1, (1 << len(p)) - 2))
    return spark.createDataFrame(rows, "part string, said string, order long, ends long, inner long")


def marked(text: Column) -> Column:
    """A text as it is split: with a blank before it, and blanks for marks."""
    return F.when(F.length(text) > 0, F.concat(F.lit(" "), F.replace(text, F.lit(MARK), F.lit(" ")))).otherwise("")


@cache
def _kinds() -> np.ndarray:
    kinds = np.fromiter((LETTER if _letter(chr(x)) else OTHER for x in range(0x110000)), np.uint8, 0x110000)
    kinds[[ord(" "), ord("\n")]] = BLANK, FEED
    return kinds


def _begins(u8: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where words begin in the UTF-8 bytes of texts, which begin at ``texts``."""
    at = np.flatnonzero((u8 & 0xC0) != 0x80).astype(np.int32)
    point = u8[at].astype(np.int32)
    wide = np.flatnonzero(point >= 0xC0)
    first, after = point[wide], [u8[np.minimum(at[wide] + k, len(u8) - 1)].astype(np.int32) & 63 for k in (1, 2, 3)]
    two, three = (first & 31) << 6 | after[0], (first & 15) << 12 | after[0] << 6 | after[1]
    four = (first & 7) << 18 | after[0] << 12 | after[1] << 6 | after[2]
    point[wide] = np.minimum(np.where(first < 0xE0, two, np.where(first < 0xF0, three, four)), 0x10FFFF)
    kind = _kinds()[point]
    begins = np.ones(len(at), bool)
    begins[1:] = BEGINS[kind[:-1] << 2 | kind[1:]]
    begins[np.searchsorted(at, texts)] = True
    return at[begins]


def split(texts: pa.Array) -> tuple[np.ndarray, pa.StringArray]:
    """How many words each of the :func:`marked` texts has, and all words, which share the texts' bytes."""
    texts = texts.cast(pa.string())
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or ends[0] == ends[-1]:
        return np.zeros(len(texts), np.int64), pa.array([], pa.string())
    u8, found, k = np.frombuffer(texts.buffers()[2], np.uint8), [], 0
    while k < len(texts):
        to = max(k + 1, int(np.searchsorted(ends, ends[k] + SPLIT, "right")) - 1)
        heads = ends[k:to][np.diff(ends[k : to + 1]) > 0] - ends[k]
        if len(heads):
            found.append(_begins(u8[ends[k] : ends[to]], heads) + ends[k])
        k = to
    begins = np.concatenate(found).astype(np.int32)
    values = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, ends[-1])), texts.buffers()[2])
    return np.diff(np.searchsorted(begins, ends)), values


def _mask(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def _hex(i: Column | int, width: int) -> Column | str:
    """The hex digits of an id below 2**16 in ``width`` bytes, the least one first."""
    if isinstance(i, int):
        return i.to_bytes(width, "little").hex()
    turned = F.shiftleft(i.bitwiseAND(255), 8).bitwiseOR(F.shiftright(i, 8))
    return F.concat(F.substr(F.hex(turned + 65536), F.lit(2), F.lit(4)), F.lit("0000" * (width // 2 - 1)))


def _byte_ids(c: Codec, x: Column, width: int) -> Column:
    """The ids of a character without a piece, by its code point."""
    byte = lambda b: _hex(b + c.byte_ids[0], width)
    tail = lambda n: byte(F.shiftright(x, 6 * n).bitwiseAND(63) + 128)
    return (
        F.when(x < 0x80, byte(x))
        .when(x < 0x800, F.concat(byte(F.shiftright(x, 6) + 0xC0), tail(0)))
        .when(x < 0x10000, F.concat(byte(F.shiftright(x, 12) + 0xE0), tail(1), tail(0)))
        .otherwise(F.concat(byte(F.shiftright(x, 18) + 0xF0), tail(2), tail(1), tail(0)))
    )


def folded(rows: DataFrame, c: Codec, width: int = 4) -> DataFrame:
    """The rows and data, the ids of their word in ``width`` bytes each. Words differ, have at most SHORT characters, and are best dealt by ``word``."""
    n, others = F.length("word"), [x for x in rows.columns if x != "word"]
    starts = rows.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    parts = starts.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(c.longest), n - F.col("i")))).alias("l"))
    parts = parts.withColumn("part", F.substr("word", F.col("i") + 1, F.col("l")))
    edges = parts.join(F.broadcast(piece_table(rows.sparkSession, c, width)), "part", "left").where("said is not null or l = 1")
    moved = lambda mask, none: F.call_function("shiftleft", F.coalesce(mask, F.lit(none).cast("long")), F.col("i"))
    edge = F.struct(
        (F.coalesce("order", F.lit(0).cast("long")) + F.shiftleft("i", 5)).alias("order"),
        moved("ends", 3).alias("ends"),
        moved("inner", 0).alias("inner"),
        F.coalesce("said", _byte_ids(c, F.ascii("part"), width)).alias("said"),
    )
    grouped = edges.groupBy("word").agg(*(F.first(x).alias(x) for x in others), F.collect_list(edge).alias("edges"))

    def take(mask: Column, e: Column) -> Column:
        fits = (mask.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(mask.bitwiseAND(e["inner"])) == 1)
        return F.when(fits, mask.bitwiseAND(F.bitwise_not(e["inner"]))).otherwise(mask)

    def path(mask: Column) -> Column:
        on = F.filter("edges", lambda e: mask.bitwiseAND(e["ends"].bitwiseOR(e["inner"])) == e["ends"])
        return F.sort_array(F.transform(on, lambda e: F.struct(e["ends"], e["said"])))

    found = F.aggregate(F.sort_array("edges"), _mask(n + 1) - 1, take, path)
    return grouped.select("word", *others, F.unhex(F.array_join(F.transform(found, lambda e: e["said"]), "")).alias("data"))


def _fold_stored(rows: DataFrame, c: Codec, name: str) -> DataFrame:
    """:func:`folded`, written. A task's words are grouped in memory, up to GROUPED; by default Spark sorts all edges from the 129th word on."""
    conf, key = rows.sparkSession.conf, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = conf.get(key)
    conf.set(key, str(GROUPED))
    try:
        return stored(folded(rows, c, 2), name)
    finally:
        conf.set(key, before)


def known_words(docs: DataFrame, c: Codec, sample: int = SAMPLE, most: int = KNOWN) -> DataFrame:
    """(word, n, data) of at most ``most`` words, the commonest ones of ``sample`` documents or so."""
    some = least_hashed(docs, F.xxhash64("text"), sample // 2)
    counted = some.select(marked(F.col("text")).alias("text")).mapInArrow(_counted, "word string, n long")
    counts = stored(counted.where(F.length("word") <= SHORT).groupBy(F.replace("word", F.lit(" "), F.lit(MARK)).alias("word")).agg(F.sum("n").alias("n")), "counts")
    least, total = 1, 0
    for r in counts.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).collect():  # 10,000 rows at most
        total += r["words"]
        if total > most:
            total -= r["words"]
            least = r["n"] + 1
            break
    out = _fold_stored(counts.where(F.col("n") >= least).repartition(total // TASK + 1, "word"), c, "words")
    removed(counts)
    return out


class Known:
    """The broadcast words of one query and where the ids of each lie, read once by each worker."""

    held: dict[str, "Known"] = {}

    def __init__(self, stream: bytes):
        said = pa.ipc.open_stream(stream).read_all().combine_chunks()
        self.words = pa.concat_arrays([*said["word"].cast(pa.string()).chunks, pa.array([], pa.string())])
        data = said["data"].to_pylist()
        self.lengths, self.ids = _lengths(data), np.frombuffer(b"".join(data), "<u2")

    @classmethod
    def of(cls, name: str, table: Broadcast) -> "Known":
        if name not in cls.held:
            cls.held.clear()
            cls.held[name] = cls(table.value)
        return cls.held[name]


def _lengths(data: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, data), np.int64, len(data)) // 2


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of a batch's texts and how often each stands there."""
    for b in _texts(batches):
        word, n = pc.value_counts(split(b.column("text"))[1]).flatten()
        for k in range(0, len(word), BLOCK):
            yield pa.RecordBatch.from_arrays([word[k : k + BLOCK], n[k : k + BLOCK]], ["word", "n"])


def _parts(b: pa.RecordBatch, size: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose sizes come to ``most`` at most, if more than one."""
    ends, k = np.concatenate([[0], np.cumsum(size)]), 0
    while k < b.num_rows:
        to = max(k + 1, int(np.searchsorted(ends, ends[k] + most, "right")) - 1)
        yield b.slice(k, to - k)
        k = to


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from _parts(b, pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False).astype(np.int64), PART)
    pa.default_memory_pool().release_unused()  # the worker stays


def _looked_up(b: pa.RecordBatch, known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Of a batch: how many words each text has, the number of each word among the known ones (-1: none), and text and word of each miss."""
    n, values = split(b.column("text"))
    number = pc.fill_null(pc.index_in(values, value_set=known.words), -1).to_numpy(zero_copy_only=False)
    row = np.searchsorted(np.cumsum(n), np.flatnonzero(number < 0), "right")
    return n, number, row, values.filter(pa.array(number < 0)).dictionary_encode()


def _missed(batches: Iterator[pa.RecordBatch], name: str, table: Broadcast) -> Iterator[pa.RecordBatch]:
    """text_key and word of the words that are not known, each once in a batch; long words are left out."""
    for b in _texts(batches):
        _, _, row, word = _looked_up(b, Known.of(name, table))
        short = pc.less_equal(pc.utf8_length(word.dictionary), SHORT).to_numpy(zero_copy_only=False)
        keys, at = np.unique(b.column("text_key").to_numpy(), return_inverse=True)
        code = word.indices.to_numpy().astype(np.int64)
        key, code = np.divmod(np.unique((at[row] * max(1, len(short)) + code)[short[code]]), max(1, len(short)))
        for k in range(0, len(key), BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array(keys[key[k : k + BLOCK]], pa.int64()), word.dictionary.take(pa.array(code[k : k + BLOCK]))], ["text_key", "word"])


def _numbered(batches: Iterator[pa.RecordBatch], name: str, table: Broadcast) -> Iterator[pa.RecordBatch]:
    """Texts as the numbers of their words, compressed with the words that are not known, which have the numbers after the known ones.

    Numbers are laid out byte by byte: first the least bytes of all, at last the highest.
    """
    zstd = pa.Codec("zstd")
    for b in _texts(batches):
        known = Known.of(name, table)
        n, number, row, word = _looked_up(b, known)
        number = number.astype("<u4")
        most = max(1, len(word.dictionary))
        own, at = np.unique(row * most + word.indices.to_numpy().astype(np.int64), return_inverse=True)
        first = np.searchsorted(own // most, np.arange(len(n) + 1))
        ends = np.concatenate([[0], np.cumsum(n)])
        number[number == 0xFFFFFFFF] = len(known.words) + at - first[row]
        said = word.dictionary.take(pa.array(own % most)).to_pylist()
        packed, sizes = [], []
        for k in range(len(n)):
            planes = number[ends[k] : ends[k + 1]].view(np.uint8).reshape(-1, 4).T.tobytes()
            whole = planes + "\n".join(w if w != "\n" else "" for w in said[first[k] : first[k + 1]]).encode()  # no other word has a line feed
            packed.append(zstd.compress(whole, asbytes=True))
            sizes.append(len(whole))
        columns = [b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n", "own", "size", "packed"])


def _gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` that ``which`` names, one after the other, and where each ends."""
    n = lengths[which]
    ends = np.cumsum(n)
    return values[np.repeat(starts[which] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)], ends


def _assembled(batches: Iterator[pa.RecordBatch], path: str | None, ids: bool, name: str, table: Broadcast) -> Iterator[pa.RecordBatch]:
    """Rows of documents from the numbers of their words: ids of known words, of those folded for the text, and of long ones, which are folded here."""
    c, known, zstd = codec(path), Known.of(name, table), pa.Codec("zstd")
    types, names = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())], ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "ids"]
    letters, size = np.frombuffer(b"".join(c.said), np.uint8), np.array(list(map(len, c.said)), np.int64)
    letters_at, most = np.cumsum(size) - size, len(known.words)
    for b in (part for b in batches for part in _parts(b, b.column("n").to_numpy(), PART // 8)):
        texts, data = [], []
        misses = b.column("misses")
        for k, (n, own, whole, packed) in enumerate(zip(*(b.column(x).to_pylist() for x in ("n", "own", "size", "packed")), strict=True)):
            blob = zstd.decompress(packed, whole, asbytes=True)
            number = np.frombuffer(blob, np.uint8, 4 * n).reshape(4, -1).T.copy().view("<u4").reshape(-1).astype(np.int64)
            if own:
                number[number >= most] += len(data)
                folds = {c.word_of(x): x for x in misses[k].as_py() or ()}
                data += [folds.get(w) or np.array(c.ids_of(w.decode().replace(" ", MARK)), "<u2").tobytes() for w in (x or b"\n" for x in blob[4 * n :].split(b"\n"))]
            texts.append(number)
        lengths = np.concatenate([known.lengths, _lengths(data)])
        values, starts = np.concatenate([known.ids, np.frombuffer(b"".join(data), "<u2")]), np.cumsum(lengths) - lengths
        out: list[list] = [[], [], [], [], []]
        for doc_id, number in zip(b.column("doc_id").to_pylist(), texts, strict=True):
            parts, bytes_, crc = [], [], 0
            for at in range(0, len(number), BLOCK):
                some = _gathered(values, starts, lengths, number[at : at + BLOCK])[0].astype("<u4")
                crc = zlib.crc32(some, crc)
                bytes_.append(_gathered(letters, letters_at, size, some)[0].tobytes())
                parts.append(some)
            told = hashlib.sha256(c.text_of(b"".join(bytes_)).encode()).hexdigest()
            for column, x in zip(out, (doc_id, sum(map(len, parts)), crc, told, np.concatenate([np.array([], "<u4"), *parts]) if ids else None), strict=True):
                column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)][: 4 + ids], names[: 4 + ids])


def encoded(docs: DataFrame, path: str | None = None, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), decoded_sha256 and, with ``ids``, the ids."""
    c, spark = codec(path), docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    common = known_words(own, c).select(F.replace("word", F.lit(MARK), F.lit(" ")).alias("word"), "n", "data").toArrow().sort_by([("n", "descending")])  # KNOWN words of SHORT characters at most
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, common.schema) as w:
        w.write_table(common)
    name, table = uuid.uuid4().hex, spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    once = own.select("doc_id", F.xxhash64("text", salt("doc_id")).alias("text_key"), marked(F.col("text")).alias("text"))
    tasks = (own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARE + 1
    pairs = once.select("text_key", "text").mapInArrow(lambda b: _missed(b, name, table), "text_key long, word string")
    pairs = pairs.withColumn("word", F.replace("word", F.lit(" "), F.lit(MARK))).repartition(tasks, "word")
    rare = _fold_stored(pairs.groupBy("word").agg(F.collect_set("text_key").alias("text_keys")), c, "rare")
    misses = rare.select(F.explode("text_keys").alias("text_key"), "data").repartition("text_key").groupBy("text_key").agg(F.collect_list("data").alias("misses"))
    numbered = once.mapInArrow(lambda b: _numbered(b, name, table), "doc_id long, text_key long, n long, own long, size long, packed binary")
    told = numbered.join(misses.hint("shuffle_hash"), "text_key", "left").select("doc_id", "n", "own", "size", "packed", "misses")
    schema = "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string" + ", ids array<long>" * ids
    return told.mapInArrow(lambda b: _assembled(b, path, ids, name, table), schema)


def decoded(tokens: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of a table of ids; null ids give null."""
    c = codec(path)
    table = tokens.sparkSession.createDataFrame([(i, s.hex()) for i, s in enumerate(c.said)], "id long, said string")
    own = tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    key = F.unhex(F.md5(F.to_json(F.struct("doc_id", "ids"), {"ignoreNullFields": "false"}).cast("binary")))
    rows = own.groupBy(key.alias("row")).agg(F.first("doc_id").alias("doc_id"), F.first("ids").alias("ids"), F.count(F.lit(1)).alias("copies"))
    said = rows.select("row", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(table), "id").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "said"))).alias("parts"))
    text = F.decode(F.unhex(F.array_join(F.transform("parts", lambda p: p["said"]), "")), "UTF-8")
    whole = F.when(F.col("ids").isNotNull(), F.coalesce(F.regexp_replace(text, "^ ", ""), F.lit("")))
    out = rows.join(said, "row", "left").select("doc_id", whole.alias("text"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return out.drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read(spark, sf_dir, "documents"))
