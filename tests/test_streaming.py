import datetime as dt

import pytest

from partloom.streaming import events as st


@pytest.fixture
def stream(spark, tmp_path):
    def make(rows, schema):
        path = str(tmp_path / f"in{len(rows)}{abs(hash(schema)) % 1000}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        return spark.readStream.schema(schema).parquet(path)

    return make


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.sql(f"select * from {name}").collect()


def t(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_demand_by_window(spark, stream):
    rows = [(1, t(5), "view"), (2, t(20), "error"), (3, t(50), "purchase"), (4, t(70), "click"), (5, t(300), "view")]
    got = {r.start: (r.searches, r.failed, r.sales) for r in run(spark, st.demand(stream(rows, "event_id long, ts timestamp, event_type string")), "demand", "complete")}
    assert got[t(0)] == (1, 1, 1) and got[t(60)] == (1, 0, 0)


def test_once(spark, stream):
    rows = [(1, t(5)), (1, t(6)), (2, t(7))]
    assert sorted(r.event_id for r in run(spark, st.once(stream(rows, "event_id long, ts timestamp")), "once")) == [1, 2]


def test_search_to_sale(spark, stream):
    a = stream([(7, t(0), 10), (7, t(60), 11), (8, t(0), 12)], "user_id long, ts timestamp, code long")
    b = stream([(7, t(15), 20), (7, t(81), 21)], "user_id long, ts timestamp, code long")
    got = [(r.user_id, r.asked_code, r.sold_code) for r in run(spark, st.search_to_sale(a, b), "near")]
    assert got == [(7, 10, 20)]


def test_attempts(spark, stream):
    rows = [(i, 9, t(i), "error") for i in range(5)] + [(9, 8, t(1), "error")]
    got = run(spark, st.attempts(stream(rows, "event_id long, user_id long, ts timestamp, event_type string"), 3), "attempts", "complete")
    assert {r.user_id for r in got} == {9} and max(r.attempts for r in got) == 5


def test_inbox_state(spark, stream):
    rows = [(1, 0, "user"), (1, 1, "assistant"), (1, 2, "user"), (2, 0, "user"), (2, 1, "user"), (2, 1, "user")]
    got = {r.conv_id: (r.turns, r.waiting) for r in run(spark, st.inbox(stream(rows, "conv_id long, turn long, role string")), "inbox", "update")}
    assert got == {1: (3, 1), 2: (2, 2)}
