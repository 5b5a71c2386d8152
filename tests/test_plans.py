"""Every registered query against DuckDB on the smallest tables."""

import datetime
import math
import os
import re

import duckdb
import pytest

from lodestrata import plans

SF_DIR = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "-"
    if isinstance(x, float):
        return f"{x:.6g}"
    return x.isoformat() if isinstance(x, datetime.date) else str(x)


def rows(found):
    return sorted(tuple(map(plain, r)) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF_DIR}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = rows(df.select(*columns).collect())
    sql = plans.oracle_sql().get(name)
    if sql is None:
        return
    told = duck.sql(sql)
    assert sorted(told.columns) == columns
    assert {c: TYPES[k] for c, k in df.dtypes} == dict(zip(told.columns, map(str, told.types), strict=True))
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert got == rows(duck.sql(f"select {quoted} from ({sql})").fetchall())


def test_unicode_metrics_reads_whole_texts(spark, tmp_path):
    from lodestrata.functions.text import LEGAL_FUNCTIONS

    rows = [(1, "simple words " * 40 + "whoever investigates it"), (2, "simple words " * 40), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    kind = lambda t: next((n for n, p in LEGAL_FUNCTIONS if re.search(p, (t or "").lower())), "other")
    got = {r.doc_id: r.kind for r in plans.queries()["unicode_metrics"](spark, str(tmp_path)).collect()}
    assert got == {k: kind(t) for k, t in rows} and got[1] != "other"


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_cer_metrics_against_brute_force(spark, tmp_path):
    texts = {1: "small mill\nall. done " * 9, 2: "", 3: None, 4: "one two three. four five six seven eight nine\tten m", 5: "é m l."}
    spark.createDataFrame([*texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for k, t in texts.items():
        t = t or ""
        read = t.replace("m", "rn").replace("l", "1").replace(".", "")
        want[k] = (round(edits(read, t) / max(1, len(t)), 6), round(edits(read.split(), t.split()) / max(1, len(t.split())), 6))
    got = {r.doc_id: (r.cer, r.wer) for r in plans.queries()["cer_metrics"](spark, str(tmp_path)).collect()}
    assert got == {k: (pytest.approx(a, abs=1e-6), pytest.approx(b, abs=1e-6)) for k, (a, b) in want.items()}


def test_cer_metrics_deals_texts_over_tasks(spark):
    plan = plans.queries()["cer_metrics"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("hashpartitioning(doc_id")


def test_gate_fit_against_brute_force(spark, duck):
    from lodestrata.operators.gates import FIT, FIT_REACH
    from lodestrata.plans.documents import INDICATORS, PROVISIONS

    def verdict(k, text):
        said, indicator = PROVISIONS[k % len(PROVISIONS)].lower(), INDICATORS[k % len(INDICATORS)]
        blob = f"{said} {text[:FIT_REACH].lower()}"
        has = lambda *names: all(re.search(FIT[n], blob) for n in names)
        if k % 11 == 0:
            return "FAIL"
        if indicator in ("P6-I1", "P6-I4") and not has("abroad", "transfer"):
            return "FAIL"
        if indicator == "P6-I1":
            return "PASS" if has("ban") else "FAIL"
        if indicator == "P6-I4":
            return "PASS" if has("condition") else "FAIL"
        if indicator == "P6-I2":
            return "PASS" if has("retain", "records", "domestic", "duty") or has("records", "kept_out") else "FAIL"
        if indicator == "P6-I3":
            return "PASS" if has("infrastructure", "domestic") and (has("duty") or has("service_condition")) else "FAIL"
        if indicator == "P7-I3":
            if not has("retain", "records", "duty") or has("ceiling") or re.search(FIT["licence"], said) and not re.search(FIT["data"], said):
                return "FAIL"
            return "PASS" if has("duration") else "WARN"
        if indicator == "P7-I5":
            return "FAIL" if not has("government", "access", "object") else "WARN" if has("judicial") and not has("without_judicial") else "PASS"
        return "PASS"

    texts = dict(duck.sql("select doc_id, text from documents").fetchall())
    got = {r.doc_id: r.g7 for r in plans.queries()["gate_fit"](spark, SF_DIR).collect()}
    assert got == {k: verdict(k, t) for k, t in texts.items()} and set(got.values()) == {"PASS", "WARN", "FAIL"}


def test_coverage_deals_both_sides_by_rows(spark, monkeypatch):
    from lodestrata import session
    from lodestrata.plans import matching

    d = "/root/testdata/sf0.001"
    whole = {tuple(r) for r in matching.coverage_complete(spark, d).collect()}
    monkeypatch.setattr(session, "SPREAD", 100)
    found = matching.coverage_complete(spark, d)
    n = -(-spark.read.parquet(f"{d}/lineitem.parquet").count() // 100)
    assert found._jdf.queryExecution().executedPlan().toString().count(f", {n}), REPARTITION_BY_NUM") == 2
    assert {tuple(r) for r in found.collect()} == whole
