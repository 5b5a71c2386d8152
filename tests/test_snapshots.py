"""Snapshots, bulk decisions and manifests: what fails leaves the last state in force."""

import pytest
from pyspark.sql import functions as F

from lodestrata.sources import snapshots


def rows(spark, *values, at="t1"):
    return spark.createDataFrame([(k, v, at) for k, v in enumerate(values)], "k long, v string, generated_at string")


def test_one_snapshot_is_active(spark, tmp_path, monkeypatch):
    store = snapshots.Snapshots(spark, f"file://{tmp_path}/s")
    assert store.active() is None
    first, written = store.take({"a": rows(spark, "x", None)}, ("a",), ("generated_at",))
    assert written and store.table("a").count() == 2
    assert store.take({"a": rows(spark, "x", None, at="t2").repartition(3)}, (), ("generated_at",)) == (first, False) and len(store.log.entries()) == 1
    second, _ = store.take({"a": rows(spark, "y")}, (), ("generated_at",))
    assert store.active() == second and {r.v for r in store.table("a").collect()} == {"y"}
    # An import that dies before its entry leaves the old one active; so does one without a required table.
    monkeypatch.setattr(snapshots.Log, "commit", lambda *_: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        store.take({"a": rows(spark, "z")})
    monkeypatch.undo()
    with pytest.raises(ValueError):
        store.take({"a": rows(spark, "z")}, ("b",))
    assert store.active() == second and {r.v for r in store.table("a").collect()} == {"y"}
    assert store.take({"a": rows(spark, "x", None)}, (), ("generated_at",)) == (first, False) and store.active() == first
    third, _ = store.take({"a": rows(spark, "w")}, keep=2)
    assert {e["folder"] for e in store.log.entries()} == {first["folder"], second["folder"], third["folder"]}
    assert {p.name for p in (tmp_path / "s/data").iterdir() if not p.name.startswith(".")} >= {first["folder"][5:], third["folder"][5:]} and not (tmp_path / "s" / second["folder"]).exists()
    # One that is gone is written again.
    assert store.take({"a": rows(spark, "y")}, (), ("generated_at",), keep=2)[1]


def test_a_number_is_taken_once(spark, tmp_path):
    log = snapshots.Log(spark, f"file://{tmp_path}/l")
    log.commit(0, {"a": 1})
    with pytest.raises(snapshots.Conflict):
        log.commit(0, {"a": 2})
    assert log.entries() == [{"a": 1}]


def test_all_or_no_decisions(spark, tmp_path, monkeypatch):
    ledger = snapshots.Decisions(spark, f"file://{tmp_path}/d")
    items = spark.createDataFrame([("k1", "KNOWN", "s1", True), ("k2", "KNOWN", "s2", True), ("k3", "NEW", "s3", True), ("k4", "KNOWN", "s4", False)], "key string, queue string, subject string, exact boolean")
    ask = lambda *pairs: spark.createDataFrame([*pairs], "key string, token string")
    at = F.lit("2024-01-01 00:00:00")
    approve = lambda asked, stage="citation", who="r1": ledger.approve_all(items, asked, stage, who, at, lambda: F.when(~F.col("exact"), "not exact"))
    for bad in (ask(), ask(("k1", None), ("k1", None)), ask(("k1", None), ("k3", None)), ask(("k1", None), ("zz", None)), ask(("k1", None), ("k4", None)), ask(*((f"k{n}", None) for n in range(201)))):
        with pytest.raises(ValueError):
            approve(bad)
    with pytest.raises(snapshots.Conflict):
        approve(ask(("k1", None), ("k2", "seen")))
    assert ledger.ledger().count() == 0 and ledger.log.entries() == []
    assert approve(ask(("k1", None), ("k2", None))) == 2
    with pytest.raises(snapshots.Conflict):
        approve(ask(("k1", None)))
    with pytest.raises(ValueError):
        approve(ask(("k1", None)), "mapping")
    token = {r.key: r.token for r in ledger.latest("citation").collect()}
    # Of two that saw the same state one wins, and nothing of the other stays.
    seen = ledger.log.entries()
    monkeypatch.setattr(ledger.log, "entries", lambda: seen)
    assert approve(ask(("k1", token["k1"])), who="r2") == 1
    with pytest.raises(snapshots.Conflict):
        approve(ask(("k2", token["k2"]), ("k1", token["k1"])), who="r3")
    monkeypatch.undo()
    assert {(r.key, r.reviewer) for r in ledger.ledger().collect()} == {("k1", "r1"), ("k2", "r1"), ("k1", "r2")} and len(ledger.log.entries()) == 2


def test_manifests(spark, tmp_path):
    (tmp_path / "b/sub").mkdir(parents=True)
    for name, text in (("one.txt", "1"), ("sub/two.txt", "22"), ("sub/three.txt", "333")):
        (tmp_path / "b" / name).write_text(text)
    rows = spark.createDataFrame(snapshots.manifest(spark, f"file://{tmp_path}/b").collect(), "file string, byte_length long, sha256 string")
    assert {(r.file, r.byte_length) for r in rows.collect()} == {("one.txt", 1), ("sub/two.txt", 2), ("sub/three.txt", 3)}
    assert snapshots.root_hash(rows) == snapshots.root_hash(rows.repartition(3)) and snapshots.verify(rows, spark, f"file://{tmp_path}/b").count() == 0
    (tmp_path / "b/one.txt").write_text("x")
    (tmp_path / "b/sub/two.txt").unlink()
    (tmp_path / "b/new.txt").write_text("n")
    assert {tuple(r) for r in snapshots.verify(rows, spark, f"file://{tmp_path}/b").collect()} == {("one.txt", "changed"), ("sub/two.txt", "missing"), ("new.txt", "unlisted")}
    assert snapshots.root_hash(snapshots.manifest(spark, f"file://{tmp_path}/b")) != snapshots.root_hash(rows)
