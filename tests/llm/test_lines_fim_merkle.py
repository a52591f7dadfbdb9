"""Operators 11 to 13 against brute force, and their defined cases."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from strataframe.llm import fill_in_middle, line_dedup, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, id long, x long, pos int, g string, idx long, size long, n long, output string, range string, first long"


def table(spark, rows, partitions=3):
    """(doc_id, text, source) with other columns whose names the operators use inside."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else None, len(r[1]) if r[1] else None, "h", 1, 2, 3, "g", 4, 5, 6, "o", "r", 7) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- 13 fill-in-middle ----------------------------------------------------------------------------------------------------------


def plain_cut(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    d = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def fim_rows():
    rng = random.Random(5)
    bits = ["\n", "\n\n", "a", "é", "中文", "😀", "\r\n", "<", ">", "<S", "P>", " ", "\x00", "word "]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(30)))) for k in range(400)]
    return [*rows, (500, None), (501, ""), (502, "\n"), (503, "no end"), (504, "a<P>b\nc"), (505, "<S>"), (None, "x\ny\nz"), (506, "l\n" * 200_000), (506, "l\n" * 200_000), (-3, "a\nb\nc"), (507, "<\n<\n<")]


def test_fim_against_lists(spark, monkeypatch):
    monkeypatch.setattr(fill_in_middle, "BATCH", 1000)
    rows = fim_rows()
    made = fill_in_middle.transformed(table(spark, rows))
    got = made.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: [(v is None, str(v)) for v in r]
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got], key=key) == sorted([(i, *plain_cut(i, t), t or "") for i, t in rows], key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("rate,spm", [(0, 50), (60, 0), (60, 100)])
def test_fim_rates(rate, spm):
    for i, t in fim_rows()[:200]:
        n, form, a, b, out = fill_in_middle.cut((t or "").encode(), i, 3, rate, spm)
        assert (n, form, a, b, out.decode()) == plain_cut(i, t, 3, rate, spm)


def test_fim_ranks():
    rng = random.Random(8)
    for size in (1, 2, 63, 64, 65, 1000):
        bits = rng.getrandbits(size)
        places = [i for i in range(size) if bits >> i & 1]
        assert [fill_in_middle.select(bits, k, size) for k in range(len(places))] == places


def test_fim_of_nothing(spark):
    assert fill_in_middle.transformed(table(spark, [])).count() == 0


def test_fim_bytes_that_are_no_utf8(spark):
    docs = spark.sql("SELECT 1L doc_id, CAST(X'61FF0A62C30A0A' AS STRING) text")
    (row,) = fill_in_middle.transformed(docs).select("n", fill_in_middle.restored(F.col("output"), F.col("form")).cast("binary").alias("back"), F.col("output").cast("binary").alias("out")).collect()
    n, *_, out = fill_in_middle.cut(b"a\xff\nb\xc3\n\n", 1)
    assert row.n == n == 3 and bytes(row.out) == out


# ---- 12 lines -------------------------------------------------------------------------------------------------------------------


def plain_lines(rows, least=10):
    white = "\x20\x09\x0a\x0b\x0c\x0d"
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(white))
    first = {}
    order = lambda i: (i is None, i or 0)
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= least and (k not in first or order(i) < order(first[k])):
                first[k] = i
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if first.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def line_rows():
    rng = random.Random(6)
    said = ["a line that is long", "A LINE that is Long\t", "  a line that is long", "ÉÉ éé ÜÜ üü 123", "éé ÉÉ ÜÜ üü 123", "short", "", " ", "\x0b ten chars! \x0c", " ten chars!", "exactly 10", "exactly10", "\r", "x" * 500]
    said += [f"line number {k}" for k in range(60)]
    rows = [(k, "\n".join(rng.choice(said) for _ in range(rng.randrange(200)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "\n"), (103, "the only one here\n"), (-5, "a line that is long\nline number 3"), (None, "line number 4\nnot seen before\nline number 5"), (None, "not seen before\nline number 5\nbut here")]
    rows += [(7, "line number 9\nline number 9\na new line of row 7"), (104, "same row, twice\nline number 1"), (104, "same row, twice\nline number 1"), (200, "\n".join(f"row {k} of a long text" for k in range(20_000))), (201, "\n".join(f"row {k} of a long text" for k in range(0, 30_000, 7)))]
    return rows


@pytest.mark.parametrize("hot", [line_dedup.HOT, 16, 2])
def test_lines_against_a_dictionary(spark, hot):
    """With few hot keys allowed and with many; the results are the same."""
    rows = line_rows()
    docs = table(spark, rows)
    got = line_dedup.without_repeats(docs, hot=hot)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    key = lambda r: [(v is None, str(v)) for v in r]
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()], key=key) == sorted(plain_lines(rows), key=key)


def test_hot_lines_are_known_and_spread(spark):
    """A line that a third of the rows are is found by the sketch, with its first document, and lies in no one range."""
    rows = [(k, f"one line in all texts\nline of {k} alone\nand {k} once more") for k in range(3000)]
    lines = line_dedup.stored(line_dedup.keys(table(spark, rows, 6)), "lines")
    hot = line_dedup.hot_keys(lines, 64).collect()
    assert [r["first"] for r in hot] == [0]
    gone = line_dedup.repeats(lines, 64)
    assert gone.count() == 2999
    plan = gone._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(range" in plan and "Python" not in plan and "Arrow" not in plan


def test_bitmap_words(spark):
    df = spark.createDataFrame([(1, 2, p) for p in (0, 63, 64, 700, 700)] + [(1, 3, 5)], "id long, x long, pos int")
    got = {r.x: (r.drops, r.n_dropped, r.bits) for r in line_dedup.bitmaps(df).withColumn("bits", line_dedup.spread(F.col("drops"))).collect()}
    assert [tuple(d) for d in got[2][0]] == [(0, 1 - 2**63), (1, 1), (10, 1 << 60)] and got[2][1] == 4
    assert got[2][2] == [1 - 2**63, 1, *[0] * 8, 1 << 60] and got[3][1:] == (1, [32])


def test_lines_of_nothing(spark):
    assert line_dedup.without_repeats(table(spark, [])).count() == 0
    (row,) = line_dedup.without_repeats(table(spark, [(1, None)])).collect()
    assert (row.text, row.n_lines, row.n_dropped) == ("", 1, 0)


# ---- 11 Merkle ------------------------------------------------------------------------------------------------------------------


def plain_tree(leaves):
    """Root and, for each leaf, its siblings and the way to fold it."""
    level, ways = list(leaves), [[] for _ in leaves]
    under = [[k] for k in range(len(leaves))]
    while len(level) > 1:
        runs = [range(a, min(a + 3, len(level))) for a in range(0, len(level), 3)]
        for run in runs:
            for k in run:
                for x in under[k]:
                    ways[x].append(("".join(level[j] for j in run if j < k), "".join(level[j] for j in run if j > k)))
        under = [[x for k in run for x in under[k]] for run in runs]
        level = [sha("".join(level[k] for k in run)) for run in runs]
    return level[0], ways


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, s: sha("".join(map(field, (i, s, None, len(t) if t else None, t))))
    of = lambda i, t, s: leaf(i, t.replace("\n", "") if t is not None else None, s) if t is None else sha("".join(map(field, (i, s, None, len(t) if t else None, t.replace("\n", "")))))
    groups = collections.defaultdict(list)
    for i, t, s in rows:
        forged = of(i, t, s) if i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else leaf(i, t, s)
        groups[s].append((i is not None, i or 0, leaf(i, t, s), forged, i))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        groups[s].sort(key=lambda g: g[:3])
        trees[s] = plain_tree([g[2] for g in groups[s]])
    root, above = plain_tree([trees[s][0] for s in sources])
    out = []
    for s, over in zip(sources, above):
        for (_, _, h, forged, i), way in zip(groups[s], trees[s][1]):
            fold = forged
            for left, right in way + over:
                fold = sha(left + fold + right)
            out.append((i, h, trees[s][0], root, sha("".join(a + b for a, b in way + over)), fold, fold == root))
    return out


def merkle_rows(spark, rows, partitions=3):
    docs = table(spark, rows, partitions)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    forged = F.when(tampered, merkle.leaf(*(F.replace(F.col(f), F.lit("\n")) if f == "text" else F.col(f) for f in merkle.FIELDS)))
    out = merkle.manifest(docs, carried={"forged": forged}).withColumn("fold", merkle.folded(F.coalesce("forged", "leaf"), F.col("proof")))
    hexed = [merkle.text_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return [tuple(r) for r in out.select("doc_id", *hexed, merkle.siblings_digest(F.col("proof")).alias("p"), "fold", (F.col("fold") == merkle.text_of(F.col("root"))).alias("ok")).collect()]


CASES = {
    "one": [(1, "a\nb", "s")],
    "two lone sources": [(1, "a", "s"), (2, "b", None)],
    "sizes": [(i, f"text {i}\n", f"s{n}") for n in (1, 2, 3, 4, 9, 10, 28) for i in range(n)],
    "odd rows": [(5, "x\ny", "é"), (5, "x\ny", "é"), (5, "z", "é"), (None, "n\n", "é"), (None, None, "z"), (7, None, None), (8, "", None), (9, "q\n", ""), (10, "\n" * 50_000 + "w" * 100_000, "é"), (2**63 - 1, "中\n文", "😀"), (-(2**63), "a\n", "￿")],
    "hot": [(k, f"{k}\n", "hot" if k % 3 else f"s{k % 7}") for k in range(120)],
    "many sources": [(k, f"{k}\n", f"s{k}") for k in range(40)],
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_manifest_by_brute_force(spark, case):
    key = lambda r: [(v is None, str(v)) for v in r]
    assert sorted(merkle_rows(spark, CASES[case]), key=key) == sorted(plain_manifest(CASES[case]), key=key)


def test_manifest_of_nothing(spark):
    assert merkle.manifest(table(spark, [])).count() == 0


def test_indices_of_a_hot_group_lie_in_many_ranges(spark):
    rows = spark.range(20_000).selectExpr("if(id % 10 = 0, 'b', 'a') g", "(id * 7919) % 20011 id").repartition(5)
    got = merkle.indexed(rows, "g", "id").orderBy("g", "idx").collect()
    for g, n in (("a", 18_000), ("b", 2_000)):
        own = [r for r in got if r.g == g]
        assert [r.idx for r in own] == list(range(n)) and [r.id for r in own] == sorted(r.id for r in own) and {r.size for r in own} == {n}


def test_manifest_finds_what_was_changed(spark):
    docs = table(spark, [(k, f"text {k}", f"s{k % 3}") for k in range(30)])
    out = merkle.manifest(docs, carried={"forged": F.when(F.col("doc_id") == 11, merkle.leaf(F.lit("x")))})
    fold = merkle.folded(F.coalesce("forged", "leaf"), F.col("proof"))
    assert [r.doc_id for r in out.where(fold != merkle.text_of(F.col("root"))).collect()] == [11]
