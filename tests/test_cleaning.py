"""Cleaning rules with dirty rows, and the whole run from CSV files."""

import pytest

from conftest import by
from stallwise.operators.cleaning import clean_rows, examine, quality_row, reconcile_orders
from stallwise.plans.cleaning import clean_tables, run_cleaning
from stallwise.schemas import columns_of, require_columns
from stallwise.sources.tables import append_rows, read_raw_csv, update_by_key


def _raw(spark, name, rows):
    cols = columns_of(name)
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ", ".join(f"{c} string" for c in cols) + ", _row int")


def _run(spark, name, rows, known=None, **kw):
    examined = examine(_raw(spark, name, rows), name, known or {}, row_order=["_row"], **kw)
    return clean_rows(examined, name), quality_row(examined, name).first()


def test_users(spark):
    t = "2026-01-01 00:00:00"
    clean, report = _run(spark, "users", [
        ("U1", "30", " M ", "A", t, t, t), ("U1", "30", "M", "A", t, t, t), (None, "30", "M", "A", t, t, t),
        ("U2", "20", "F", None, t, t, t), ("U2", "20", "F", None, t, t, t), ("U3", "20", "F", "B", "never", t, t)])
    assert {r["user_id"] for r in clean.collect()} == {"U1", "U2"}
    assert by(clean, "user_id")["U1"]["gender"] == "M"
    assert (report["missing"], report["duplicates"], report["illegal"]) == (1, 2, 1)
    assert report["dropped_rows"] == 4


def test_items(spark):
    t = "2026-01-01 00:00:00"
    cats = spark.createDataFrame([("C1",)], "category_id string")
    clean, report = _run(spark, "items", [("I1", "a", "C1", "b", "10.5", "100", "1", t), ("I2", "a", "C1", "b", "-1", "5", "2", t),
                                          ("I3", "a", "C1", "b", "20", "-3", "0", t), ("I4", "a", "C9", "b", "20", "3", "0", t)], {"categories": cats})
    assert [r["item_id"] for r in clean.collect()] == ["I1"]
    assert (report["illegal"], report["fk"]) == (2, 1)


def test_behaviors_rebuild_reference_and_time(spark):
    users = spark.createDataFrame([("U1", "2026-08-01 00:00:00")], "user_id string, register_time string")
    items = spark.createDataFrame([("I1",)], "item_id string")
    rows = [("B1", "U1", "I1", "pv", "2026-08-04 19:30:00", "1999-01-01", "3", "mobile", "organic"),
            ("B2", "U9", "I1", "pv", "2026-08-04 19:30:00", "x", "3", "mobile", "organic"),
            ("B3", "U1", "I9", "pv", "2026-08-04 19:30:00", "x", "3", "mobile", "organic"),
            ("B4", "U1", "I1", "pv", "2026-07-04 19:30:00", "x", "3", "mobile", "organic"),
            ("B5", "U1", "I1", "pv", "2026-09-04 19:30:00", "x", "3", "mobile", "organic")]
    clean, report = _run(spark, "user_behaviors", rows, {"users": users, "items": items}, data_end="2026-08-31")
    row = clean.first()
    assert (row["behavior_id"], str(row["event_date"]), row["event_hour"]) == ("B1", "2026-08-04", 19)
    assert (report["fk"], report["time_rule"], report["final_rows"]) == (2, 2, 1)
    assert report["time_detail"] == "before_register=1,after_end=1"


def test_later_copy_of_a_bad_first_row_is_dropped(spark):
    t = "2026-01-01 00:00:00"
    clean, report = _run(spark, "users", [("U1", "5", "M", "A", t, t, t), ("U1", "30", "M", "A", t, t, t)])
    assert clean.count() == 0 and report["duplicates"] == 1 and report["illegal"] == 1


def test_reconcile(make):
    orders = make.orders([("O1", "U1", "2026-08-01T00:00:00", 5, "paid"), ("O2", "U1", "2026-08-01T00:00:00", 7, "paid"), ("O3", "U1", "2026-08-01T00:00:00", 9, "paid")])
    lines = make.lines([("O1", "I1", 1, 2.5), ("O1", "I2", 1, 2.5), ("O2", "I1", 1, 8)])
    got = by(reconcile_orders(orders, lines), "order_id")
    assert {k: (r["total_amount"], r["corrected"]) for k, r in got.items()} == {"O1": (5.0, False), "O2": (8.0, True), "O3": (9.0, False)}


def test_missing_column_is_reported_before_any_job(spark):
    with pytest.raises(ValueError, match="missing columns"):
        require_columns(spark.createDataFrame([(1,)], "user_id int"), ["user_id", "age"], "users")


def test_append_and_update(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    old.write.parquet(path)
    new = spark.createDataFrame([("b", 9), ("c", 3), ("c", 3)], "k string, v int")
    for _ in range(2):
        append_rows(spark, path, new, "k")
    assert {r["k"]: r["v"] for r in spark.read.parquet(path).collect()} == {"a": 1, "b": 2, "c": 3}
    assert spark.read.parquet(path).count() == 3
    updated = update_by_key(old, spark.createDataFrame([("b", 7)], "k string, v int"), "k", ["v"])
    assert {r["k"]: r["v"] for r in updated.collect()} == {"a": 1, "b": 7}


def test_run_from_csv(spark, tmp_path):
    t = "2026-08-01 00:00:00"
    files = {
        "categories": ["category_id,category_name,parent_id", "C1,top,", "C2,leaf,C1", "C3,lost,C9"],
        "users": ["user_id,age,gender,city,register_time,created_at,updated_at", f"U1,30,M,A,{t},{t},{t}", f"U2,99,M,A,{t},{t},{t}"],
        "items": ["item_id,item_name,category_id,brand,price,stock,status,created_at", f"I1,n,C2,b,5,1,1,{t}", f"I2,n,C3,b,5,1,1,{t}"],
        "user_behaviors": ["behavior_id,user_id,item_id,behavior_type,event_time,event_date,event_hour,device_type,channel",
                           "B1,U1,I1,pv,2026-08-02 10:00:00,2026-08-02,10,pc,ads", "B1,U1,I1,pv,2026-08-02 10:00:00,2026-08-02,10,pc,ads",
                           "B2,U2,I1,pv,2026-08-02 10:00:00,2026-08-02,10,pc,ads", "B3,U1,I1,zap,2026-08-02 10:00:00,2026-08-02,10,pc,ads"],
        "orders": ["order_id,user_id,order_time,total_amount,status,payment_method", "O1,U1,2026-08-02 11:00:00,4,paid,card"],
        "order_items": ["order_id,item_id,quantity,unit_price,amount", "O1,I1,1,5,5", "O1,I1,1,5,5", "O1,I1,0,5,5"],
    }
    raw = tmp_path / "raw"
    raw.mkdir()
    for name, lines in files.items():
        (raw / f"{name}.csv").write_bytes(b"\xef\xbb\xbf" + "\n".join(lines).encode())
    out = str(tmp_path / "out")
    for _ in range(2):
        run_cleaning(spark, str(raw), out, "2026-08-31")
    counts = {n: spark.read.parquet(f"{out}/{n}").count() for n in files}
    assert counts == {"categories": 2, "users": 1, "items": 1, "user_behaviors": 1, "orders": 1, "order_items": 1}
    assert spark.read.parquet(f"{out}/orders").first()["total_amount"] == 5.0
    report = by(spark.read.json(f"{out}/quality_report"), "table_name")
    assert (report["user_behaviors"]["duplicates"], report["user_behaviors"]["illegal"], report["user_behaviors"]["fk"]) == (1, 1, 1)
    lazy = clean_tables({n: read_raw_csv(spark, f"{raw}/{n}.csv", n) for n in files}, "2026-08-31", ["_row"])
    assert {n: df.count() for n, df in lazy.tables.items()} == counts
