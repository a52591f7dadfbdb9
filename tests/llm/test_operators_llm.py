"""The ten operators against brute force, and their defined cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strataframe.llm import components, exact_dedup, html_extract, kdtree, license_scan, packing, pii, quality, sentencepiece_codec, shared, simhash, substring_dedup

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, norm string, fp long, sig long, word string, length long, component_id string"


def table(spark, rows, partitions=3):
    """Documents with other columns whose names the operators use inside."""
    full = [(i, t, None, None, len(t) if t else None, "x", "y", 1, 2, "z", 3, "c") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def words_of(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """(id, text) with copies, near copies, shared passages, nulls, blanks, repeated rows and one long text."""
    a, b, c, p = words_of(180, 1), words_of(90, 2), words_of(70, 3), words_of(60, 4)
    near = list(a)
    near[90] = "other"
    rows = [(10, " ".join(a)), (11, " ".join(a) + " "), (12, "  ".join(a)), (13, " ".join(near)), (14, " ".join(b + p)), (15, " ".join(p + c)), (16, " ".join(c[:10] + p[:49] + b[:5])), (17, " ".join(p))]
    rows += [(20, None), (21, ""), (22, " \n\t "), (23, "one two"), (24, "ONE two"), (None, " ".join(p)), (17, " ".join(p)), (25, " ".join(["na"] * 300)), (26, " ".join(["na"] * 120)), (27, "é ß 中文 😀 ￿"), (28, " ".join(words_of(30_000, 9, 9000)))]
    return rows


# ---- 5 exact dedup ----------------------------------------------------------------------------------------------------------


def test_exact_groups(spark, corpus):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", "", t or "")
    groups = collections.defaultdict(list)
    for i, t in corpus:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
    want = sorted((str(i), str(min(groups[norm(t)])[3]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in corpus)
    got = exact_dedup.exact_groups(table(spark, corpus)).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    kept = exact_dedup.without_copies(table(spark, corpus))
    assert kept.columns == table(spark, corpus).columns
    assert {r.doc_id for r in kept.collect()} >= {12, 13, 28} and not {10, 11} & {r.doc_id for r in kept.collect()}


def test_survivors_are_rows_not_ids(spark):
    """Repeated and null ids, equal rows, the least long: one row of each group stays, and no other row goes."""
    a, b, c = (" ".join(words_of(40, 70 + k)) for k in range(3))
    rows = [(1, a), (1, b), (2, a), (None, b), (None, c), (None, c), (3, c), (7, "same row"), (7, "same row"), (-(2**63), "x y"), (5, "xy "), (2**63 - 1, "x  y")]
    docs = table(spark, rows)
    got = exact_dedup.exact_groups(docs).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == sorted(
        [("1", "1", 2), ("2", "1", 2), ("1", "1", 2), ("None", "1", 2), ("None", "3", 3), ("None", "3", 3), ("3", "3", 3), ("7", "7", 2), ("7", "7", 2)] + [(i, str(2**63 - 1), 3) for i in (str(-(2**63)), "5", str(2**63 - 1))]
    )
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, a), (1, b), (3, c), (7, "same row"), (2**63 - 1, "x  y")])
    near = simhash.one_of_each_group(table(spark, [*rows[:9], (9, "same row"), (None, "quite alone"), (None, "quite alone")]))
    assert sorted((str(r.doc_id), r.text) for r in near.collect()) == sorted([("1", a), ("1", b), ("3", c), ("7", "same row"), ("None", "quite alone")])


def test_exact_dedup_moves_all_texts_when_hashes_are_many(spark, corpus, monkeypatch):
    want = sorted(map(str, exact_dedup.exact_groups(table(spark, corpus)).collect()))
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(shared.few, "__defaults__", (0,))
    assert sorted(map(str, exact_dedup.exact_groups(table(spark, corpus)).collect())) == want
    assert sorted(str(r.doc_id) for r in exact_dedup.without_copies(table(spark, corpus)).collect()) == sorted(str(r) for r in [12, 13, 14, 15, 16, 17, 22, 23, 24, 25, 26, 27, 28])


def test_least_hashed_counts_keys_not_rows(spark):
    for ids in ([2, 3], [1, 2, 3], range(40_000)):
        df = spark.range(40_000).select(F.element_at(F.array(*map(F.lit, ids)), (F.col("id") % len(ids) + 1).cast("int")).alias("k")) if len(ids) < 9 else spark.range(40_000).select(F.col("id").alias("k"))
        n = shared.least_hashed(df, F.xxhash64("k"), 2000).select("k").distinct().count()
        assert n == len(ids) if len(ids) < 9 else 3400 < n < 4600


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError):
        shared.scratch_dir(Session())


def test_exact_groups_of_nothing(spark):
    assert exact_dedup.exact_groups(table(spark, [])).count() == 0


# ---- 8 SimHash --------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps):
    """Root (least index) of each fingerprint by all pairs."""
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_fingerprints_and_components(spark, corpus):
    got = simhash.near_groups(table(spark, corpus)).collect()
    fps = [plain_fingerprint(t) for _, t in corpus]
    root = linked(fps)
    least = collections.defaultdict(lambda: 1 << 60)
    for r, (i, _) in zip(root, corpus):
        least[r] = min(least[r], 1 << 60 if i is None else i)
    want = sorted((str(i), f"{f:016x}", str(least[r])) for (i, _), f, r in zip(corpus, fps, root))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert len(simhash.one_of_each_group(table(spark, corpus)).columns) == 12


def test_covering_masks_meet_every_pair():
    for i in range(64):
        for j in range(64):
            assert any(not (mask >> i & 1 or mask >> j & 1) for mask in simhash.TABLES)


def test_links_of_a_crowded_bucket(spark):
    rng = random.Random(2)
    fps = {0}
    while len(fps) < 150:  # a chain of near fingerprints, and strangers
        f = rng.choice(sorted(fps)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        fps.add(f)
    fps = sorted(fps | {rng.getrandbits(64) for _ in range(100)})
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    root = {r.node: r.root for r in components.components(simhash.links(df)).collect()}
    group = collections.defaultdict(set)
    for f, r in zip(fps, linked(fps)):
        group[r].add(simhash.signed(f))
    assert {frozenset(g) for g in group.values() if len(g) > 1} == {frozenset(k for k in root if root[k] == r) for r in set(root.values())}


def test_components_of_a_path(spark):
    path = list(range(200))
    random.Random(4).shuffle(path)
    edges = spark.createDataFrame(list(zip(path, path[1:])) + [(500, 500), (600, 601)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == dict.fromkeys(range(200), 0) | {600: 600, 601: 600}


# ---- 10 substring dedup -----------------------------------------------------------------------------------------------------


def plain_cut(rows):
    first = {}
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - 49):
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - 49):
                if first[tuple(w[k : k + 50])] < i:
                    gone[k : k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((str(i), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("batch", [2_000_000, 600])
def test_repeats(spark, corpus, monkeypatch, batch):
    got = substring_dedup.without_repeats(table(spark, corpus)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_cut(corpus)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_repeats_random(spark):
    rng = random.Random(8)
    passages = [words_of(rng.randint(45, 80), 100 + k, 50) for k in range(6)]
    rows = [(k, " ".join(w for _ in range(rng.randint(1, 4)) for w in rng.choice([*passages, words_of(rng.randint(0, 60), 1000 + rng.randrange(9), 30)]))) for k in range(60)]
    got = substring_dedup.without_repeats(table(spark, rows, 7)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_cut(rows)
    assert substring_dedup.without_repeats(table(spark, [])).count() == 0


def test_repeats_of_colliding_words_and_repeated_ids(spark, monkeypatch):
    """A word and its complement that polynomial hashes modulo 2**64 can't tell apart; ids with several texts, and null ids."""
    thue = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    rest = words_of(49, 31, 900)
    p, q = words_of(70, 32, 900), words_of(64, 33, 900)
    rows = [(1, " ".join([thue, *rest])), (2, " ".join([thue.translate({97: 98, 98: 97}), *rest])), (3, " ".join([thue, *rest, "more"]))]
    rows += [(5, " ".join(p)), (5, " ".join(q)), (5, " ".join(p + q)), (6, " ".join(["x"] * 9 + q)), (6, " ".join(q[:60])), (6, " ".join(["y"] * 80))]
    rows += [(7, " ".join(["y"] * 55)), (None, " ".join(p)), (None, " ".join(p)), (None, None)] + [(k, " ".join(words_of(20, k) + p)) for k in range(10, 40)]
    loop = words_of(7, 35, 900) * 40
    rows += [(50, " ".join(loop)), (50, " ".join(loop + p)), (51, " ".join(loop[3:])), (49, " ".join(loop[:60]))]
    for batch, told in ((2_000_000, 1 << 18), (900, 1 << 18), (900, 0)):
        monkeypatch.setattr(substring_dedup, "BATCH_BYTES", batch)
        monkeypatch.setattr(substring_dedup, "TOLD", told)
        got = substring_dedup.without_repeats(table(spark, rows, 2)).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_cut(rows)


# ---- 4 packing --------------------------------------------------------------------------------------------------------------


def whole_ids(text):
    return packing.encoder().whole.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_tokenizer():
    rng = random.Random(6)
    texts = ["", " ", "a", " a", "a ", "a\nb", "a \nb", "a\n\nb", "a\r\nb", "don't we'll", "x <|endoftext|> y", "a b", "日本 語😀\n\x1cz", "1234 5,6", "\n"]
    texts += ["".join(rng.choice("ab' .,\n  1é中!ts") for _ in range(60)) for _ in range(300)]
    for t in texts:
        assert np.frombuffer(packing.encoder()(t), "<u4").tolist() == whole_ids(t), repr(t)


def test_encoder_of_balanced_gaps():
    """As many blanks and line feeds as gaps, but not one in each gap."""
    rng = random.Random(16)
    texts = ["a\tb\tc\n\n\nd", "x\ty z\tw\n\n", "a\u00a0b  c", " a\tb", "a\tb\n", "a\r\nb\tc\n\nd"]
    texts += ["".join(rng.choice("ab \n\t\u00a0\u2003\x1c") for _ in range(12)) for _ in range(2000)]
    for t in texts:
        assert np.frombuffer(packing.encoder()(t), "<u4").tolist() == whole_ids(t), repr(t)


def test_packing(spark, corpus):
    got = packing.pack(table(spark, corpus)).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    ids = collections.defaultdict(list)
    for i, t in corpus:
        ids[i].append([*whole_ids(t), 2])
    for r in got:
        assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    assert sum(r.length for r in got) == sum(len(x) for xs in ids.values() for x in xs)
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(p[-1]) <= 1024
    assert packing.pack(table(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_whole_and_tight(seed):
    rng = random.Random(seed)
    counts = collections.Counter(rng.choice([rng.randint(1, 1024), rng.randint(1, 100), 1024, 513]) for _ in range(rng.choice([1, 30, 3000])))
    rules, n = packing.plan(counts)
    fill = collections.defaultdict(list)
    placed = collections.Counter()
    for s, rank, m, first, offset in rules.tolist():
        assert rank == placed[s]
        placed[s] += m
        for k in range(m):
            fill[first + k].append((offset, s))
    assert placed == counts and set(fill) == set(range(n))
    for p in fill.values():
        p.sort()
        assert p[0][0] == 0 and all(a + x == b for (a, x), (b, _) in zip(p, p[1:])) and sum(p[-1]) <= 1024
    decreasing: list[int] = []
    for s in sorted(counts.elements(), reverse=True):  # best fit decreasing
        fit = [k for k, r in enumerate(decreasing) if r >= s]
        if fit:
            decreasing[min(fit, key=lambda k: decreasing[k])] -= s
        else:
            decreasing.append(1024 - s)
    assert n <= len(decreasing) * 1.01 + 1


# ---- 3 quality --------------------------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    docs, labels = shared.read(spark, "/root/testdata/sf0.01", "documents"), shared.read(spark, "/root/testdata/sf0.01", "labels")
    model = quality.fit(docs, labels)
    rows = quality.scored(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert sum(g >= 0.3 for g in good) / len(good) > 0.97


def plain_score(m, text):
    """The network read off its tables, byte by byte."""
    data = list((text or "").encode())
    act = []
    for t in range(len(data)):
        window = [data[t + k] if t + k < len(data) else 0 for k in range(quality.WIDTH)]
        act.append([max(0.0, sum(float(m["filters"][k, c, f]) for k, c in enumerate(window)) + float(m["filter_bias"][f])) for f in range(quality.FILTERS)])
    blocks = [range(a, min(a + quality.BLOCK, len(data))) for a in range(0, ((len(data) + quality.GAP - 1) // quality.BLOCK + 1) * quality.BLOCK, quality.BLOCK)]
    chunks = [list(a) + list(b) for a, b in zip(blocks, blocks[1:])] or [list(blocks[0])]
    pooled = np.zeros(quality.HIDDEN)
    for chunk in chunks:
        n = max(1, len(chunk))
        x = [sum(act[t][f] for t in chunk) / n for f in range(quality.FILTERS)] + [max(sum(t >= lag and data[t] == data[t - lag] for t in chunk) for lag in quality.LAGS) / n]
        pooled = np.maximum(pooled, np.maximum(np.array(x) @ m["dense"] + m["dense_bias"], 0))
    return 1 / (1 + np.exp(-(pooled @ m["out"] + m["out_bias"][0])))


def test_quality_scores_by_brute_force():
    rng = random.Random(12)
    texts = ["", "a", "x" * 127, "ab " * 43, "q" * 128, " ".join(words_of(90, 5)), "é中" * 60, "".join(rng.choice("abc #%") for _ in range(700)), "line\n" * 200]
    m = quality.train(texts * 3, [k % 2 for k in range(len(texts))] * 3, epochs=3)
    assert np.allclose(quality.scores(m, texts), [plain_score(m, t) for t in texts], atol=2e-4)
    assert np.allclose(quality.scores(m, texts), [quality.scores(m, [t])[0] for t in texts], atol=1e-5)  # whatever the neighbours


def test_quality_cases(spark, corpus):
    labels = spark.createDataFrame([(10, 1, 0), (10, 0, 0), (999, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = table(spark, corpus)
    got = quality.scored(docs, quality.fit(docs, labels.where("doc_id is null"))).collect()
    assert len(got) == len(corpus) and {r.score for r in got} == {0.5}
    model = quality.train(["ok text here", "### %%% &&&"] * 8, [1, 0] * 8, epochs=2)
    one = quality.scores(model, [None, "", "x" * 300_000, "ok"])
    assert one[0] == one[1] and np.isfinite(one).all()
    assert quality.scored(table(spark, []), model).count() == 0
    assert quality.without_rejected(docs, labels).columns == docs.columns


def test_training_reads_whole_texts(spark, monkeypatch):
    long = "good words here " * 1000 + "### the end"
    rows = [(i, long if i == 2 else f"text {i}") for i in range(1, 12)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "train", lambda texts, labels: seen.append(texts))
    quality.fit(table(spark, rows), labels)
    used = {t for i, t in rows if zlib.crc32(str(i).encode()) % 5}
    assert long in used and set(seen[0]) == used
    monkeypatch.setattr(quality, "TRAIN_BYTES", 1000)  # drops a row, cuts none
    quality.fit(table(spark, rows), labels)
    assert set(seen[1]) == used - {long}
    monkeypatch.setattr(license_scan, "train", lambda paragraphs: seen.append(paragraphs))
    lines = ["first " * 500, "second", "", "third", "fourth", "fifth of many " * 100]
    license_scan.fit(table(spark, [(1, "\n".join(lines))]))
    assert set(seen[2]) == {*lines, "\n".join(lines[:2]), "\n".join(lines[3:])} - {""}


def test_quality_gradient_lowers_the_loss():
    texts = ["the cat sat on a mat " * 20, "### %%% $$$ " * 20, "NA NA NA NA NA NA " * 20] * 10
    labels = [1, 0, 0] * 10
    s = quality.scores(quality.train(texts, labels, epochs=30), texts)
    assert (s[::3] > 0.7).all() and (s[1::3] < 0.3).all() and (s[2::3] < 0.3).all()


# ---- 9 top-k ----------------------------------------------------------------------------------------------------------------


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(0, 0.3, 6).round(2).tolist(), 1) for k in range(340)]
    rows += [(400, rows[0][1], 0), (401, None, 0), (402, [], 0), (403, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (404, [float("nan")] + [0.0] * 5, 0), (405, [float("inf")] + [0.0] * 5, 0), (None, [1.0] * 6, 0), (500, [1.0, 2.0], 0), (501, [0.5, 0.5], 0), (7, rows[7][1], 0), (600, [9.0], 0)]
    vec = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(kdtree, "SHARD", 60)
    ok = [(i, tuple(int(np.floor(1024 * float(np.float32(x)))) for x in v)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q in {i for i, _ in ok if i % 100 == 0}:
        qs = {v for i, v in ok if i == q}
        s = [(-sum(a * b for a, b in zip(v, w)), i) for v in qs for i, w in ok if i != q and len(w) == len(v)]
        want += [(q, k + 1, i, -s_) for k, (s_, i) in enumerate(sorted(s)[:10])]
    assert sorted(map(tuple, kdtree.top_k(vec).select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)
    assert kdtree.top_k(vec.where("false")).count() == 0


def test_top_k_of_rows_repeated_more_than_k_times(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(k, rng.normal(0, 0.3, 4).round(2).tolist()) for k in range(300)]
    top = [[2.0, 2.0, 2.0, 2.0], [-2.0, -2.0, -2.0, -2.0]]
    copies = [(1000 + i, v) for i, v in enumerate(top) for _ in range(25)] + [(300, [0.5] * 4)] * 12
    same = [(2000, [0.25, 0.5, 0.25 * j, 0.0]) for j in range(30)] + [(100, [1.0, 1.0, 0.0, 0.0])] * 2  # one id, one score for the second query
    rows += copies + same
    monkeypatch.setattr(kdtree, "SHARD", 40)
    ok = [(i, tuple(int(np.floor(1024 * float(np.float32(x)))) for x in v)) for i, v in rows]
    want = []
    for q in {i for i, _ in ok if i % 100 == 0}:
        s = [(-sum(a * b for a, b in zip(v, w)), i) for v in {v for i, v in ok if i == q} for i, w in ok if i != q]
        want += [(q, k + 1, i, -s_) for k, (s_, i) in enumerate(sorted(s)[:10])]
    vec = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    with monkeypatch.context() as m:
        m.setattr(kdtree, "BOXES", 0)  # every shard is asked
        assert sorted(map(tuple, kdtree.top_k(vec).select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)
    with pytest.raises(OverflowError):
        kdtree.top_k(spark.createDataFrame([(1, [3e15, 1.0])], "vec_id long, embedding array<double>"))
    got = sorted(map(tuple, kdtree.top_k(vec).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == sorted(want) and len(got) == 10 * len({q for q, *_ in got})


# ---- 1 HTML -----------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><article>no";</script><style>p{}</style></head><body class="x1">
<header>Top</header><nav><a href=/a>Menu</a></nav><div class="ad-box">Buy</div><div class="content c12"><h1>Head&amp;line</h1><p>First <b>bo</b>ld
 line<p>Second &lt;x&gt; &#233;<br>third<ul><li>one<li>two</ul><div class="share-bar">Share</div><form><input>Send</form><section id="comments"><p>I disagree, and at some length, with all of it.</p></section></div>
<aside>Side</aside><footer>Foot</footer>"""


def test_html_page():
    assert html_extract.extract(PAGE) == "Head&line First bold line Second <x> é third one two"
    assert html_extract.extract(None) == html_extract.extract("") == ""
    assert html_extract.extract("just text &amp; more") == "just text & more"
    assert html_extract.extract("<p>a <i title='x>y'>b</i><!-- c --> d<p") .startswith("a b d")
    assert html_extract.extract("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_html_class_words_inside_an_article():
    said = '<article><div class="article-header"><h1>Head</h1></div><p class="notice-board">Board.</p><div class="post-body">Body text of some length, with more.</div><div class="post-comments">No.</div><div class="ad1">Buy</div></article>'
    assert html_extract.extract(said + '<div class="site-header">Top</div><div id="footer-2">Foot</div>') == "Head Board. Body text of some length, with more."
    yes = "ad-box share-bar sidebar-left nav-main comment-42 ad300 cookie-consent-popup site-header related-posts legal-notice header".split()
    no = "article-header notice-board story-side main-notice content legal-news header-image shadow address adventure".split()
    assert all(map(html_extract.boilerplate, yes)) and not any(map(html_extract.boilerplate, no))


def test_html_against_built_pages():
    """Pages built of known parts: the article's blocks come back whole, whatever stands around and inside it."""
    rng = random.Random(21)
    junk = ['<nav><a href="/x">Menu %d</a></nav>', '<div class="sidebar"><p>Aside %d</p></div>', '<aside>Side %d</aside>', '<div class="cookie-bar">Accept %d</div>', "<script>var x%d = '<p>no</p>';</script>", "<style>p%d{}</style>", '<form><input value="%d"><button>Go</button></form>', "<!-- note %d -->", '<div class="ads"><p>Buy %d</p></div>']
    for k in range(200):
        blocks = [" ".join(words_of(rng.randint(8, 40), 1000 * k + j)) for j in range(rng.randint(2, 7))]
        marked = []
        for b in blocks:
            ws = [rng.choice(["%s", "%s", "%s", "<b>%s</b>", "<em>%s</em>", '<a href="/l">%s</a>', "%s&amp;co", "<span class=note>%s</span>"]) % w for w in b.split()]
            marked.append((b, rng.choice(["p", "h2", "blockquote", "li", "div"]), rng.choice([" ", "\n  "]).join(ws)))
        want = " ".join(re.sub(r"<[^>]*>", "", m).replace("&amp;", "&") for _, _, m in marked)
        noise = lambda: "".join(rng.choice(junk) % rng.randrange(99) for _ in range(rng.randint(0, 2)))  # noqa: B023, E731
        inner = noise() + "".join(f"<{t}>{m}</{t}>" + noise() for _, t, m in marked)
        page = f"<html><head><title>T {k}</title></head><body>{noise()}<header>Site</header><article>{inner}</article>{noise()}<footer>End {k}</footer></body></html>"
        assert html_extract.extract(page) == " ".join(want.split()), page


def test_html_consensus(spark):
    odd = '<body><div class="content c9"><p>Short.</p></div><div class="extra"><p>' + "Long text of a widget that is no article. " * 9 + "</p></div></body>"
    rows = [(k, f"https://H.example/{k}", PAGE.replace("First", f"First{k}")) for k in range(5)] + [(9, "http://h.example:80/z", odd), (10, None, "<p>x</p>"), (11, "https://other", None), (9, "http://h.example:80/z", odd)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("clash")).withColumn("host", F.lit(1))
    got = collections.defaultdict(list)
    for r in html_extract.main_text(pages).collect():
        got[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    assert got[9] == ["Short.", "Short."] and got[10] == ["x"] and got[11] == [""] and got[3][0].startswith("Head&line First3 bold")
    assert html_extract.main_text(pages.where("false")).count() == 0


# ---- 6 PII ------------------------------------------------------------------------------------------------------------------


def test_pii(spark):
    mail, card = "Bob.Li@mail.example.com", "4111 1111 1111 1111"
    rows = [(1, f"write {mail} or bob.li@MAIL.example.com, card {card} / 4111111111111111"), (2, f"again {mail}; call +1 (555) 123-4567 or 1-555-123-4567, ip 10.0.0.7"), (3, None), (4, ""), (5, "nothing here 12 of 34"), (1, f"card {card}")]
    rows += [(6, 'token = "0123456789abcdef0123456789abcdef01234567" TOKEN = "0123456789ABCDEF0123456789ABCDEF01234567"'), (7, "Maria Lopez met Иван Петров and Maria Lopez."), (8, " ".join(f"1.2.3.{k}" for k in range(10)))]
    docs = table(spark, rows)
    got = collections.defaultdict(list)
    out = pii.rewritten(docs)
    assert out.columns == [*docs.columns, "n_entities"]
    for r in out.collect():
        got[r.doc_id].append((r.text, r.n_entities))
    text = max(got[1])[0]
    a, b = re.findall(r"\S+@[\w.]+", text)
    assert a.lower() == b.lower() and a[0].isupper() and a.endswith(".com") and mail not in text
    c, d = re.search(r"card ([\d ]+) / (\d+)", text).groups()
    luhn = lambda s: sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(s))) % 10 == 0
    assert c.replace(" ", "") == d and luhn(d) and d != "4111111111111111" and [x for x in got[1] if x[1] == 1][0][0] == f"card {c}"
    assert a in got[2][0][0]
    p, q = re.search(r"call (.*?) or (.*?),", got[2][0][0]).groups()
    assert re.sub(r"\D", "", p) == re.sub(r"\D", "", q) and p.startswith("+1 (") and p != "+1 (555) 123-4567"
    assert got[3] == [(None, 0)] and got[4] == [("", 0)] and got[5] == [("nothing here 12 of 34", 0)]
    assert re.fullmatch(r'token = "[0-9a-f]{40}" TOKEN = "[0-9A-F]{40}"', got[6][0][0]) and got[6][0][1] == 2
    x, y, z = re.fullmatch(r"(\w+ \w+) met (\w+ \w+) and (\w+ \w+)\.", got[7][0][0]).groups()
    assert x == z and x.split()[0] in pii.GIVEN["f", "latin"] and y.split()[0] in pii.GIVEN["m", "cyrillic"]
    made = got[8][0][0].split()
    assert len(set(made)) == 10 and not set(made) & {f"1.2.3.{k}" for k in range(10)}  # ten of 10,000: distinct, none real
    assert pii.rewritten(table(spark, [])).count() == 0


def test_pii_collisions_are_drawn_again(spark):
    known = spark.createDataFrame([("ip", f"{a}.{b}.1.1") for a in range(10) for b in range(10)] + [("ip", f"{a}.{b}.2.2") for a in range(10) for b in range(10)], "kind string, canon string")
    drawn = known.join(pii.exceptions(known, "k"), ["kind", "canon"], "left").fillna(0)
    seed = pii.seed_of(F.col("kind"), F.col("canon"), F.col("attempt"), "k")
    rows = drawn.withColumn("seed", seed).select("canon", pii.surrogate(F.col("canon"), F.col("kind"), F.col("seed"), F.col("attempt")).alias("made")).collect()
    made = {r.made for r in rows}
    assert len(made) == 200 and not made & {r.canon for r in rows}


def test_pii_of_whole_texts(spark):
    """What the patterns alone find anywhere in a text is found and rewritten."""
    said = {
        "GB82 WEST 1234 5698 7654 32": "pay GB82 WEST 1234 5698 7654 32 now",
        "NL91 ABNA 0417 1643 00": "to NL91 ABNA 0417 1643 00.",
        "s3cr3tvalue99": "client_secret: s3cr3tvalue99",
        "wJalrXUtnFEMIbPxRf": "aws_secret_access_key = wJalrXUtnFEMIbPxRf",
        "abcdefghijkl": '{"access_token": "abcdefghijkl"}',
        "Maria Lopez": "(von Maria Lopez) 12x",
        "10.1.2.3": "hostv10.1.2.3 up",
        "gh" + "p_" + "a" * 24: "key gh" + "p_" + "a" * 24 + " ok",
    }
    rng = random.Random(4)
    bits = [*said, *said.values(), "token", "api_key", " = ", ": ", '"', " ", "\n", "Anna", "4111111111111111", "a@b.example.com", "+1 555 123 4567", "x", "9", "é", "-", "."]
    texts = [*said.values(), *("".join(rng.choice(bits) for _ in range(12)) for _ in range(300))]
    docs = table(spark, list(enumerate(texts)))
    plain = "|".join(f"(?:{p})" for p in pii.PATTERNS.values())
    seen = docs.select("doc_id", pii._all(F.col("text"), plain).alias("want"), F.transform(pii._kinds(pii._pieces(F.col("text"))), lambda x: x["e"]).alias("got")).collect()
    assert all(r.want == r.got for r in seen) and sum(len(r.want) for r in seen) > 500
    out = {r.doc_id: r for r in pii.rewritten(docs).collect()}
    for k, (entity, text) in enumerate(said.items()):
        assert out[k].n_entities == 1 and entity not in out[k].text and len(out[k].text) == len(text) or entity == "Maria Lopez" and entity not in out[k].text, text


def test_pii_forms(spark):
    """Forms of entities, each in a sentence; all of an entity is replaced, in its own format."""
    said = {
        "GITHUB_TOKEN=%s": "abcdefghijklmnop", "db_password: %s": "hunterhunter", "see %s now": "2001:db8::8a2e:370:7334", "at %s.": "fe80:0:0:0:202:b3ff:fe1e:8329", "call %s today": "020 7946 0958",
        "by %s, who": "ANNA SMITH", "with %s there": "Wei Zhang", "and %s too": "Anna B. Smith", "for %s and": "Anna Smith-Jones", "Dr. %s said": "Xanthe Quillfeather", "Patient: %s, ward": "Zoltan Brunk-Vale", "to %s, or": "GB82 WEST 1234 5698 7654 32", "\ufdd0 or %s here": "a.b@example.org",
    }
    rows = [(k, t % e) for k, (t, e) in enumerate(said.items())] + [(50, "Anna Smith"), (51, "ANNA SMITH"), (52, None)]
    clean = ["std::move at 12:30:45 and a::b", "The Anna river. Dr. is short", "Chapter 020 of 7946", "tokens: many words follow", "MARIA is a name", "name: unknown"]
    docs = table(spark, rows + list(enumerate(clean, 60)))
    out = {r.doc_id: r for r in pii.rewritten(docs, "a key for tests").collect()}
    for k, (t, e) in enumerate(said.items()):
        before, after = t.split("%s")
        made = out[k].text[len(before) : len(out[k].text) - len(after)]
        assert out[k].n_entities == 1 and out[k].text.startswith(before) and out[k].text.endswith(after), (t, out[k].text)
        assert not set(re.findall(r"\w{3,}", e)) & set(re.findall(r"\w{3,}", made)) - {"org"}, (e, made)
        if not any(c.isalpha() and c.isupper() for c in e[:1]):
            assert [c.isdigit() or c.isalpha() for c in made] == [c.isdigit() or c.isalpha() for c in e]
    assert out[51].text == out[50].text.upper() != "ANNA SMITH"
    assert [out[k].text for k in range(60, 66)] == clean
    again = {r.doc_id: r.text for r in pii.rewritten(docs, "one key").collect()}
    assert again == {r.doc_id: r.text for r in pii.rewritten(docs, "one key").collect()} != {k: r.text for k, r in out.items()}


def test_pii_of_a_full_format(spark):
    """All dotted numbers of single digits: surrogates get longer instead of failing."""
    known = spark.range(10_000).selectExpr("'ip' kind", "concat_ws('.', id % 10, id div 10 % 10, id div 100 % 10, id div 1000) canon")
    drawn = known.join(pii.exceptions(known, "k"), ["kind", "canon"], "left").fillna(0)
    seed = pii.seed_of(F.col("kind"), F.col("canon"), F.col("attempt"), "k")
    rows = drawn.withColumn("seed", seed).select("canon", pii.surrogate(F.col("canon"), F.col("kind"), F.col("seed"), F.col("attempt")).alias("made")).collect()
    made = {r.made for r in rows}
    assert len(made) == 10_000 and not made & {r.canon for r in rows}


# ---- 2 licences, 7 SentencePiece ----------------------------------------------------------------------------------------------


def test_licences(spark):
    model = license_scan.train([f"{' '.join(words_of(12, k))}." for k in range(300)] + ["The work of the version is a free license to the city.", "mit dem Wort"])
    hits = lambda t: [(r[0], r[1], r[4]) for r in license_scan.scan_text(model, t)]
    assert hits("some words\nReleased under the MIT License.\nmore") == [(1, "mit", True)]
    assert hits("LICENSED!! UNDER!! THE!! APACHE!! LICENSE,!! VERSION!! 2.0.") == [(0, "apache", True)]
    assert hits("This work is licensed under the GNU General Public License, version 2.") == [(0, "gpl", True)]
    assert hits("Licensed under CC BY-NC 3.0.") == [(0, "cc", True)]
    assert not [h for h in hits("the version of the work\n\n" + " ".join(words_of(5000, 3))) if h[2]]
    docs = table(spark, [(1, None), (2, ""), (3, "x\nReleased under the MIT License."), (3, "x\nReleased under the MIT License.")])
    assert [(r.doc_id, r.paragraph, r.family) for r in license_scan.scan(docs, model).collect()] == [(3, 1, "mit")] * 2
    assert license_scan.scan(table(spark, []), license_scan.fit(table(spark, []))).count() == 0


def test_wrapped_licences():
    model = license_scan.train([f"{' '.join(words_of(12, k))}." for k in range(300)] + ["The work of the version is a free license to the city.", "mit dem Wort"])
    for family, templates in license_scan.TEMPLATES.items():
        for t in templates:
            for width in (30, 72):
                for lead in ("", "# "):
                    lines = textwrap.wrap(t, width)
                    text = "\n".join(["Some words", "", *(lead + x for x in lines), "", "more words"])
                    hits = [(r[0], r[1]) for r in license_scan.scan_text(model, text) if r[4]]
                    assert (2, family) in hits or len(lines) > 1 and hits and {f for _, f in hits} == {family}, (t, width, hits)
    mit = textwrap.wrap(license_scan.TEMPLATES["mit"][3], 40)
    noisy = words_of(20, 1)
    text = "\n".join([" ".join(noisy[:9]), "to deal in the software " + noisy[3], *mit, " ".join(noisy[9:]), *mit])
    assert [r[:2] for r in license_scan.scan_text(model, text) if r[4]] == [(2, "mit"), (3 + len(mit), "mit")]


def test_sentencepiece(spark, corpus, monkeypatch):
    c = sentencepiece_codec.codec()
    rng = random.Random(3)
    pieces = [p for p in c.pieces if p.isalpha()]
    texts = [*corpus, *enumerate(["a  b\nc d ", " x", "   ", "\n\n a\tb", " " * 75 + "x  y    z", "<0x41> <s>", "é" * 300, "ab▁cd", "Don't (stop)... 1234567 {}();", "日本語のテキスト、です。" * 9, "e\u0301\u0928\u093f", "=" * 200], 1000)]
    texts += [(2000 + k, "".join(rng.choice("ab \n日é<t.,he in er") for _ in range(120))) for k in range(80)]
    texts += [(3000 + k, " ".join("".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))) for _ in range(12))) for k in range(150)]
    want = sorted((str(i), c.model.encode(t or "")) for i, t in texts)
    for known in (500_000, 40):  # with and without words that must be folded in place
        monkeypatch.setattr(sentencepiece_codec.known_words, "__defaults__", (20_000, known))
        enc = shared.stored(sentencepiece_codec.encoded(table(spark, texts), ids=True), "ids")
        rows = enc.collect()
        assert sorted((str(r.doc_id), r.ids) for r in rows) == want
        assert all(r.n_ids == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)
    back = collections.defaultdict(list)
    for r in sentencepiece_codec.decoded(enc).collect():
        back[r.doc_id].append(r.text)
    for i, t in texts:
        assert (t or "").replace("▁", " ") in back[i]
    said = {(str(i), hashlib.sha256((t or "").replace("▁", " ").encode()).hexdigest()) for i, t in texts}
    assert {(str(r.doc_id), r.decoded_sha256) for r in rows} == said
    assert sentencepiece_codec.encoded(table(spark, [])).count() == 0
    assert sentencepiece_codec.decoded(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<long>")).collect() == [(1, None), (2, "")]


def test_sentencepiece_of_the_whole_table(spark):
    docs = shared.read(spark, "/root/testdata/sf0.01", "documents")
    c = sentencepiece_codec.codec()
    want = sorted((r.doc_id, len(ids := c.model.encode(r.text or "")), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in docs.collect())
    got = sentencepiece_codec.query(spark, "/root/testdata/sf0.01")
    assert sorted((r.doc_id, r.n_ids, r.ids_crc32) for r in got.collect()) == want


def test_sentencepiece_moves_no_texts(spark, corpus, monkeypatch):
    """Words are dealt once and texts only as compressed numbers; splits, batches and tasks of any size give the same ids."""
    c = sentencepiece_codec.codec()
    texts = [*corpus, *((900 + k, f"déjà vu x{k}zq 日本\n\n  " * 30) for k in range(40)), *((2000, "copied qqzx text") for _ in range(30)), (2001, "w" * 70), (2002, "")]
    for name, n in (("SPLIT", 50), ("PART", 400), ("BLOCK", 7), ("SHARE", 1_000)):
        monkeypatch.setattr(sentencepiece_codec, name, n)
    monkeypatch.setattr(sentencepiece_codec.known_words, "__defaults__", (20_000, 40))
    enc = sentencepiece_codec.encoded(shared.stored(table(spark, texts), "texts"), ids=True)
    plan = enc._sc._jvm.PythonSQLUtils.explainString(enc._jdf.queryExecution(), "formatted")
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert moved and not any(re.search(r"\b(text|words)#", x) for x in moved)
    assert sorted((str(r.doc_id), r.ids) for r in enc.collect()) == sorted((str(i), c.model.encode(t or "")) for i, t in texts)


# ---- all ----------------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, corpus):
    import corpus_pipeline

    docs = shared.read(spark, DATA, "documents")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k < 4:
            assert out.columns == docs.columns
            out = shared.stored(out, "stage")
            assert 0 < out.count() <= docs.count()
            docs = out
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_of_an_empty_table(spark):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table(spark, []), DATA).count() == 0


def test_stages_of_odd_rows(spark, corpus, monkeypatch):
    """Null and repeated ids, null, blank and long texts and clashing columns pass all stages; rows go one by one, not by id."""
    import corpus_pipeline

    monkeypatch.setattr(quality, "THRESHOLD", 0.0)  # the classifier's own choices are tested above
    rows = [*corpus, (30, "write anna@mail.example.com"), (30, "another text of the same id"), (None, "call 555-123-4567 " + " ".join(words_of(30, 77))), (None, "quite different " + " ".join(words_of(30, 78)))]
    docs = table(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = shared.stored(stage(spark, docs, DATA), "odd")
        assert out.columns == docs.columns, name
        docs = out
    kept = docs.collect()
    assert sorted(str(r.doc_id) for r in kept if r.doc_id in (30, None)) == ["30", "30", "None", "None"]
    assert not any("anna@mail" in (r.text or "") or "555-123-4567" in (r.text or "") for r in kept)
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in kept)
    norm = [re.sub(r"[\x20\x09-\x0D]+", "", r.text or "") for r in kept]
    assert len(norm) == len(set(norm))
    packed = corpus_pipeline.STAGES[4][1](spark, docs, DATA).collect()
    assert sum(r.length for r in packed) == sum(len(whole_ids(r.text)) + 1 for r in kept)


def test_lattice_is_relational(spark):
    """Substrings are exploded, joined with the broadcast pieces, grouped by word without Python, and folded by one aggregate."""
    c = sentencepiece_codec.codec()
    out = sentencepiece_codec.folded(spark.createDataFrame([("▁words",)], "word string"), c)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 2 and "BroadcastHashJoin [part" in plan and "collect_list" in plan and "aggregate(sort_array(" in plan
    assert "Python" not in plan and "Arrow" not in plan
    assert np.frombuffer(out.first().data, "<u4").tolist() == c.model.encode("words")
