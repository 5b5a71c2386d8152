from lodestrata.operators.curation import latest_decisions
from lodestrata.streaming import ledger

SCHEMA = "id long, key string, stage string, at timestamp, decision string"


def entries(spark, rows):
    return spark.createDataFrame(rows, "id long, key string, stage string, at string, decision string").selectExpr("id", "key", "stage", "cast(at as timestamp) at", "decision")


def drained(df, mode, name):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.sql(f"select * from {name}").collect()


def test_ledger_follows_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [
        [(1, "k", "s", "2024-01-01", "approved"), (2, "n", "s", "2024-01-05", "open"), (3, "p", "s", "2024-01-01", "open"), (4, "p", "t", "2024-01-01", "open")],
        [(5, "k", "fix", "2024-01-02", ""), (6, "m", "s", "2024-01-03", "open"), (7, "n", "s", "2024-01-04", "late"), (8, "p", "s", "2024-01-01", "tie")],
        [(9, "k", "s", "2024-01-02", "too early"), (10, "k", "t", "2024-01-03", "approved")],
    ]
    for k, rows in enumerate(parts):
        entries(spark, rows).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        ledger.follow_ledger(stream, out, str(tmp_path / "check"), "key", "stage", "at", "id", "fix").awaitTermination()
        every = entries(spark, sum(parts[: k + 1], []))
        got = ledger.latest_followed(spark, out, every, "stage", "fix").collect()
        want = latest_decisions(every, "key", "stage", "at", "id", "fix").collect()
        assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == [4, 4, 5][k]
    # Only the buckets of a batch's keys are written.
    assert len(list((tmp_path / "out/state/_v=2").glob("_bucket=*"))) == 1


def test_windows_and_repeats(spark, tmp_path):
    rows = [(1, "u", "a", "2024-01-01 10:00:00", "x"), (1, "u", "a", "2024-01-01 10:00:00", "x"), (2, "u", "a", "2024-01-01 10:40:00", "x"), (3, "v", "a", "2024-01-02 01:00:00", "x")]
    path = str(tmp_path / "events")
    entries(spark, rows).coalesce(1).write.parquet(path)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(path)
    assert len(drained(ledger.deduplicated(stream(), "id", "at"), "append", "once")) == 3
    got = drained(ledger.windowed(stream(), "at", ["key"], "id"), "complete", "days")
    assert sorted((r.key, r.n, r.total) for r in got) == [("u", 3, 4), ("v", 1, 3)]
    assert sorted(r.n for r in drained(ledger.sessions(stream(), "at", ["key"]), "complete", "visits")) == [1, 1, 2]
    assert len(drained(ledger.sliding_counts(stream(), "at", ["key"], "1 hour", "30 minutes"), "complete", "rates")) == 5
