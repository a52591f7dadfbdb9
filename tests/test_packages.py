"""Package stores: round trip, faults of every kind, stopped publications; replies that are cut, deep or very long."""

from __future__ import annotations

import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from strataframe.functions import documents
from strataframe.sources import packages

LEDGER, ENTRY, ARTIFACT = "package_id long, version long, width long, height long, metadata string", "package_id long, path string, sha256 string", "package_id long, path string, bytes binary"


def sha(b):
    return hashlib.sha256(b).hexdigest()


def tables(spark, packed):
    """{id: ((version, width, height, metadata), {path: bytes}, {path: sha})}"""
    return (
        spark.createDataFrame([(k, *p[0]) for k, p in packed.items()], LEDGER),
        spark.createDataFrame([(k, path, h) for k, p in packed.items() for path, h in (p[2] if len(p) > 2 else {n: sha(b) for n, b in p[1].items()}).items()], ENTRY),
        spark.createDataFrame([(k, path, b) for k, p in packed.items() for path, b in p[1].items()], ARTIFACT),
    )


FINE = ((2, 2, 1, '{"model": "m", "note": "x"}'), {"source.rgba": b"\0" * 8, "ocr/result.json": b"{}", "empty": b""})


def test_round_trip(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    with pytest.raises(FileNotFoundError):
        packages.read(spark, store)
    packages.publish(*tables(spark, {k: FINE for k in range(20)}), store)
    packages.publish(*tables(spark, {k: ((1, 1, 1, None), {"a": b"%d" % k}) for k in range(20, 25)}), store)
    good, wrong = packages.verified(spark, store)
    assert wrong.isEmpty() and {(r.package_id, r.path, bytes(r.bytes)) for r in good.collect()} == {(k, p, b) for k in range(20) for p, b in FINE[1].items()} | {(k, "a", b"%d" % k) for k in range(20, 25)}
    with pytest.raises(FileExistsError, match="package 7 "):
        packages.publish(*tables(spark, {7: FINE, 99: FINE}), store)
    assert len(packages.publications(spark, store)) == 2 and packages.read(spark, store)[0].count() == 25


def test_all_or_nothing(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    bad = (FINE[0], FINE[1], {**{n: sha(b) for n, b in FINE[1].items()}, "empty": sha(b"x")})
    with pytest.raises(ValueError, match="3: digest_mismatch empty"):
        packages.publish(*tables(spark, {1: FINE, 3: bad}), store)
    assert packages.publications(spark, store) == [] and not [p for p in (tmp_path / "store").rglob("*") if p.is_file() and not p.name.startswith(".")]
    packages.publish(*tables(spark, {1: FINE}), store)
    # A publication whose ledgers were never finished isn't there for readers.
    target = packages.publish(*tables(spark, {2: FINE}), store)
    (tmp_path / "store" / target.rsplit("/", 1)[1] / "ledgers" / "_SUCCESS").unlink()
    assert [r.package_id for r in packages.read(spark, store)[0].collect()] == [1]
    packages.publish(*tables(spark, {2: FINE}), store)
    assert sorted(r.package_id for r in packages.read(spark, store)[0].collect()) == [1, 2]


def test_bytes_changed_later_are_found(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    target = packages.publish(*tables(spark, {1: FINE, 2: FINE}), store)
    at = spark.read.parquet(f"{target}/artifacts")
    changed = at.withColumn("bytes", F.when((F.col("package_id") == 2) & (F.col("path") == "ocr/result.json"), F.lit(b"{ }")).otherwise(F.col("bytes")))
    rows = [(r.package_id, r.path, bytes(r.bytes)) for r in changed.collect()]
    spark.createDataFrame(rows, ARTIFACT).write.mode("overwrite").parquet(f"{target}/artifacts")
    good, wrong = packages.verified(spark, store)
    assert {r.package_id for r in good.collect()} == {1} and [tuple(r) for r in wrong.collect()] == [(2, "digest_mismatch", "ocr/result.json")]


def test_faults_of_every_kind(spark):
    h = {n: sha(b) for n, b in FINE[1].items()}
    meta = lambda m: ((2, 2, 1, m), FINE[1])
    packed = {
        1: ((3, 2, 1, None), FINE[1]), 2: ((None, 2, 1, None), FINE[1]), 3: ((2, 0, 1, None), {}, {}), 4: meta('{"a": '), 5: meta('{"a": [{"b": "data:IMAGE/png"}]}'), 6: meta(json.dumps({"k": "A" * 2048})),
        7: meta(json.dumps({"k": "A" * 2044, "data:image/": 1, "x": "a\"b: data"})), 8: (FINE[0], FINE[1], {**h, "../up": sha(b"")}), 9: (FINE[0], FINE[1], {**h, "empty": "XYZ"}), 10: (FINE[0], FINE[1], {n: h[n] for n in list(h)[:2]}), 11: ((2, 3, 1, None), FINE[1]), 12: meta("{" * 3000), 13: meta('["\\u0041", "b\\/c"]'),
    }
    ledgers, entries, artifacts = tables(spark, packed)
    entries = entries.union(spark.createDataFrame([(1, "empty", h["empty"]), (77, "lost", h["empty"])], ENTRY))
    ledgers = ledgers.union(ledgers.where("package_id = 13"))
    got = sorted((r.package_id, r.fault, r.path) for r in packages.faults(ledgers, entries, artifacts).collect())
    want = [
        (1, "path_repeated", "empty"), (1, "version_unsupported", None), (2, "version_unsupported", None), (3, "canvas_invalid", None), (4, "metadata_no_json", None), (5, "metadata_image", None), (6, "metadata_opaque", None),
        (8, "artifact_missing", "../up"), (8, "path_unsafe", "../up"), (9, "digest_malformed", "empty"), (9, "digest_mismatch", "empty"), (10, "artifact_unlisted", "empty"), (11, "source_length", "source.rgba"), (12, "metadata_no_json", None),
        (13, "ledger_repeated", None), (77, "artifact_missing", "lost"), (77, "ledger_missing", None),
    ]
    assert got == want
    assert packages.faults(*(t.where("false") for t in (ledgers, entries, artifacts))).isEmpty()


def test_replies_of_any_size():
    big = '{"a":[' + ",".join('{"k":[%d]}' % i for i in range(100_000)) + ',{"k": tru'
    begin = time.time()
    assert json.loads(documents.parsed(big))["a"][-1] == {"k": [99_999]}
    assert documents.parsed("[" * 200_000) is None and documents.parsed('{"a": x ' + "[]" * 500_000) is None
    assert time.time() - begin < 20
    assert documents.parsed('{"a": [1, {"b": 2}, {"c": fals') == '{"a":[1,{"b":2}]}' and documents.parsed('{"a": "b') == '{"a":"b"}' and documents.parsed("no") is None


def test_deep_replies_in_a_column(spark):
    df = spark.createDataFrame([("[" * 100_000,), ('{"a": 1',), (None,)], "t string")
    assert [r[0] for r in df.select(documents.json_repaired(F.col("t"))).collect()] == [None, '{"a":1}', None]
    assert [r[0] for r in df.select(documents.metadata_pruned(F.col("t"))).collect()] == [None, None, None]
