"""Transactions that crash between any two steps, databases opened again, and what stays bounded."""

import random
import time

import pytest

from tests.test_law import COMMENTS, ISSUES, flagship, seeded
from tidepool.engine import Engine
from tidepool.errors import StoreError
from tidepool.operators import view
from tidepool.plans import ir
from tidepool.sources import snapshots
from tidepool.sources.snapshots import SnapshotStore


class Crash(Exception):
    pass


def state(engine):
    return engine.version, *[sorted(tuple(r) for r in engine.store.read(t).collect()) for t in ("issues", "comments")]


OPS = [ir.Update("issues", 1, (("priority", 100),)), ir.Delete("comments", 52), ir.Insert("comments", (900, 1, 9, "new"))]


@pytest.mark.parametrize("step", ["first files", "second files", "draft", "rename", "old files"])
def test_a_crash_leaves_all_of_a_transaction_or_nothing(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "db")
    engine = seeded(spark, path)
    before = state(engine)
    calls = []

    def crash(*_):
        raise Crash

    with monkeypatch.context() as m:
        if step in ("first files", "second files"):
            real = SnapshotStore._bytes
            m.setattr(SnapshotStore, "_bytes", lambda self, p: crash() if calls.append(p) or len(calls) == (1 if step == "first files" else 2) else real(self, p))
        elif step == "draft":
            m.setattr(SnapshotStore, "_commit", crash)
        elif step == "rename":  # the draft is there, its place is not
            m.setattr(SnapshotStore, "_manifest", lambda self, n: f"{self.path}/_commits/{n:020d}.json" if calls.append(n) or len(calls) < 2 else crash())
        else:
            m.setattr(SnapshotStore, "_remove_old", crash)
        with pytest.raises(Crash):
            engine.mutate(OPS, ("host", 7))
    again = Engine(spark, engine.catalog, path)
    if step == "old files":
        assert state(again)[0] == before[0] + 1 and state(again) != before
    else:
        assert state(again) == before and not again.store.has_applied(("host", 7))
    again.mutate(OPS if step != "old files" else OPS, ("host", 7))
    assert again.version == before[0] + 1
    assert [r.priority for r in again.store.lookup("issues", [1]).values()] == [100]
    assert set(again.store.lookup("comments", [52, 900])) == {900}


def test_an_opened_database_goes_on(spark, tmp_path):
    path = str(tmp_path / "db")
    engine = seeded(spark, path)
    engine.mutate([ir.Delete("issues", 5)], ("host", 1))
    engine.mutate([], ("host", 2))
    assert engine.version == 1
    again = Engine(spark, engine.catalog, path)
    assert again.version == 1 and again.store.has_applied(("host", 2)) and not again.store.has_applied(("host", 3))
    assert again.mutate([ir.Delete("issues", 1)], ("host", 1)) == 1 and 1 in again.store.lookup("issues", [1])
    assert again.mutate([ir.Delete("issues", 1)], ("host", 3)) == 2
    with again.subscribe(flagship()) as live:
        assert [r[0] for r in live.rows] == [4, 3, 2]
    with pytest.raises(StoreError):  # the first engine doesn't know of that transaction
        engine.mutate([ir.Delete("issues", 2)])
    assert state(Engine(spark, engine.catalog, path)) == state(again)


def test_ranges_of_numbers():
    rng, ranges, numbers = random.Random(1), [], set()
    for _ in range(300):
        n = rng.randrange(120)
        ranges, numbers = snapshots._with_number(ranges, n), numbers | {n}
        assert {x for a, b in ranges for x in range(a, b + 1)} == numbers and all(b + 1 < c for (_, b), (c, _) in zip(ranges, ranges[1:]))


def test_a_stream_goes_on_where_the_database_is(spark, tmp_path):
    from tidepool.streaming.feed import Feed, feed_schema

    path = str(tmp_path / "db")
    engine = seeded(spark, path)
    schema = feed_schema(engine.catalog.table("issues"))
    first, second = (spark.createDataFrame(x, schema) for x in ([(1, "U", 1, (1, 1, 77, 0, "up"))], [(2, "D", 1, None)]))
    Feed(engine, "issues").apply(first, 0)
    again = Engine(spark, engine.catalog, path)
    feed = Feed(again, "issues")
    feed.apply(second, 0)  # comes again after a failure
    assert again.version == 1 and 1 in again.store.lookup("issues", [1])
    feed.apply(second, 1)
    feed.apply(second, 2)  # no change
    assert again.version == 2 and not again.store.lookup("issues", [1])
    assert Engine(spark, engine.catalog, path).store.stream_at(feed.stream) == 2


def test_a_micro_batch_is_broadcast_and_the_table_is_not_shuffled(spark, tmp_path):
    from tidepool.plans import lower
    from tidepool.streaming.feed import batch_of, feed_schema, last_images

    engine = seeded(spark, str(tmp_path / "db"))
    last = last_images(spark.createDataFrame([(1, "U", 1, (1, 1, 77, 0, "up")), (2, "D", 3, None)], feed_schema(engine.catalog.table("issues"))))
    plan = lower.explain(batch_of(engine, "issues", last, 2))
    assert plan.count("BroadcastHashJoin LeftSemi") and "SortMergeJoin" not in plan
    assert sorted(r.key for r in batch_of(engine, "issues", last, 2).collect()) == sorted(r.key for r in batch_of(engine, "issues", last).collect()) == [1, 3]


def test_many_small_writes_leave_the_base_and_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "KEPT", 3)
    path = tmp_path / "db"
    engine = seeded(spark, str(path))
    engine.store.most_changes = 4
    base = engine.store._state["tables"]["issues"]["base"]
    for n in range(14):
        engine.mutate([ir.Update("issues", 1 + n % 5, (("priority", n),)), ir.Insert("issues", (100 + n, 3, n, 0, "x"))])
    own = engine.store._state["tables"]["issues"]
    assert own["base"] == base and len(own["changes"]) <= 4
    assert len(engine.store._numbers()) <= 6
    assert len(list((path / "issues").iterdir())) <= 14
    rows = {r.id: r.priority for r in engine.store.read("issues").collect()}
    assert len(rows) == 21 and rows[4] == 13 and rows[113] == 13
    monkeypatch.setattr(snapshots, "LEAST_BYTES", 0)
    engine.mutate([ir.Delete("issues", 100)])
    own = engine.store._state["tables"]["issues"]
    assert own["base"] != base and not own["changes"] and engine.store.read("issues").count() == 20
    assert state(Engine(spark, engine.catalog, str(path))) == state(engine)


def test_bases_can_be_searched_by_key_and_relation(spark, tmp_path):
    engine = seeded(spark, str(tmp_path / "db"))
    with engine.subscribe(flagship()):
        pass
    from tidepool.plans import lower
    from tidepool.plans.compile import compile_query

    child = compile_query(flagship(), engine.catalog).children[0]
    parents = spark.createDataFrame([(5, 1, 50, 0, "a")], ISSUES)
    frame = lower.attach(parents, 1, child, engine.tables, [5])
    assert "In(issue_id, [5])" in lower.explain(frame) or "EqualTo(issue_id,5)" in lower.explain(frame)
    assert [x.id for x in frame.first()["comments"]] == [52]
    import glob

    import pyarrow.parquet as pq

    (file,) = [f for f in glob.glob(f"{engine.store._state['tables']['comments']['base']}/*.parquet")][:1]
    column = pq.read_metadata(file).row_group(0).column(COMMENTS.names.index("issue_id"))
    assert column.statistics.has_min_max


def test_operators_and_what_they_give_up(spark):
    engine = seeded(spark)
    with engine.subscribe(flagship()) as live, engine.subscribe(ir.Query("issues", allow_unbounded=True)) as whole:
        assert live.live.node_names() == ["source issues", "filter", "top k", "source comments", "join comments", "view"]
        assert whole.live.node_names() == ["source issues", "requery", "view"]
        report = dict(engine.inspect()[live.number])
        assert report["top k"] > 0 and report["join comments"] > 0 and report["filter"] == 0
        assert sum(report.values()) + sum(n for _, n in whole.live.state_report()) == engine.stats().graph_bytes
        out = dict(live.live.degrade_report())
        assert out["top k"].kind == "shed" and out["top k"].freed_bytes > 0 and out["join comments"].kind == "pinned" and out["source issues"].kind == "stateless"
        assert dict(whole.live.degrade_report())["requery"].kind == "pinned"
        engine.mutate([ir.Delete("issues", 5)])
        assert [r[0] for r in live.rows] == [4, 3, 2]


def test_positional_diff_of_long_lists():
    rng = random.Random(2)
    for n in (0, 1, 2, 9, 60):
        for _ in range(40):
            old = [(k, (k, rng.randrange(3))) for k in rng.sample(range(80), n)]
            new = [(k, (k, rng.randrange(3))) for k in rng.sample(range(80), rng.randint(0, n + 5))]
            changes = view.positional_diff(old, new)
            assert view.replay([r for _, r in old], changes) == [r for _, r in new]
    same = [(k, (k,)) for k in range(100_000)]
    start = time.time()
    assert len(view.positional_diff(same, same[::-1])) == 99_999 and not view.positional_diff(same, same)
    assert time.time() - start < 4


def test_a_list_of_some_columns_is_kept_from_changes(spark):
    engine = seeded(spark)
    query = flagship()
    query = ir.Query(query.table, query.where, query.order, 3, query.related, params=(1,), select=("title", "id"))
    with engine.subscribe(query) as live:
        assert live.live.node_names()[-2:] == ["project", "view"] and "top k" in live.live.node_names()
        events = []
        engine.on_delta(events.append)
        shown = [x.row for x in live.initial.changes]
        for ops in ([ir.Delete("issues", 5)], [ir.Update("issues", 1, (("priority", 99),))], [ir.Insert("comments", (900, 1, 9, "new"))], [ir.Update("issues", 3, (("closed", 1),))], [ir.Update("issues", 4, (("title", "said anew"),))]):
            engine.mutate(ops)
            with engine.subscribe(query) as fresh:
                assert live.rows == fresh.rows
        for e in events:
            shown = view.replay(shown, e.changes)
        assert shown == live.rows and [r[:2] for r in shown] == [("issue 1", 1), ("said anew", 4), ("issue 2", 2)]


def test_rows_of_the_driver_are_part_of_the_plan(spark):
    import datetime
    import decimal

    from pyspark.sql import types as T

    from tidepool.sources.local import frame_of, is_local

    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("s", T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.BinaryType()), T.StructField("d", T.DateType()), T.StructField("n", T.DecimalType(10, 2)), T.StructField("f", T.DoubleType())]))])
    rows = [(1, ("x", b"\0y", datetime.date(2020, 2, 29), decimal.Decimal("1.50"), float("inf"))), (2, None), (None, (None,) * 5)]
    frame = frame_of(spark, rows, schema)
    assert is_local(frame) and frame.schema == schema
    assert [tuple(r) for r in frame.collect()] == [tuple(r) for r in spark.createDataFrame(rows, schema).collect()]
    assert is_local(frame_of(spark, [], schema)) and frame_of(spark, [], schema).count() == 0
    for bad in ((1.5, None), ("1", None), (1, ("x", b"", None, None, 1))):
        with pytest.raises(Exception):
            frame_of(spark, [bad], schema)
    when = T.StructType([T.StructField("t", T.TimestampType())])
    now = datetime.datetime(2024, 3, 1, 12)
    assert frame_of(spark, [(now,)], when).first() == spark.createDataFrame([(now,)], when).first()


def test_changes_in_memory_are_merged_beside_the_base(spark):
    engine = seeded(spark)
    engine.store.most_changes = 3
    engine.load("issues", spark.range(2000).selectExpr("id", "1 AS project_id", "id AS priority", "0L AS closed", "'t' AS title"))
    base = engine.store._frames["issues"]
    with engine.subscribe(flagship()) as live:
        for n in range(9):
            engine.mutate([ir.Delete("issues", live.rows[0][0])])
        assert [r[0] for r in live.rows] == [1990, 1989, 1988]
    assert engine.store._frames["issues"] is base and len(engine.store._parts["issues"]) <= 3
    assert engine.store.read("issues").count() == 1991
