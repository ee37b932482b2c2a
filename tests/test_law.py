"""The law: a list kept up to date equals the list evaluated from scratch."""

import random

import pytest
from pyspark.sql import types as T

from tests import oracle
from tidepool.engine import Engine
from tidepool.operators import deltas, view
from tidepool.operators.incremental import LiveList
from tidepool.plans import ir, lower
from tidepool.plans.compile import compile_query
from tidepool.schema import Catalog, Relation, Table
from tidepool.sources.local import frame_of

PARENT = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("r", T.DoubleType()), T.StructField("t", T.StringType())])
CHILD = T.StructType([T.StructField("id", T.LongType()), T.StructField("p", T.LongType()), T.StructField("v", T.DoubleType())])
KEYS = {"parents": "id", "children": "id"}
RELATIONS = {("parents", "children"): ("n", "p")}


def catalog():
    return Catalog().add(Table("parents", PARENT, "id")).add(Table("children", CHILD, "id")).relate(Relation("children", "parents", "children", "n", "p"))


def frames(spark, state):
    return {"parents": spark.createDataFrame(list(state["parents"].values()), PARENT), "children": spark.createDataFrame(list(state["children"].values()), CHILD)}


def rows_of(state):
    return {name: [dict(zip(s.names, r)) for r in state[name].values()] for name, s in (("parents", PARENT), ("children", CHILD))}


def parent(rng, key):
    return (key, rng.choice([None, 0, 1, 2, 3]), rng.choice([None, 0.0, 1.0, 1.5]), rng.choice([None, "", "a", "ab"]))


def child(rng, key):
    return (key, rng.choice([None, 0, 1, 2, 3]), rng.choice([None, -2.0, 1.0, 3.0]))


def transaction(rng, state):
    """Edits against live state, three sets to two removals."""
    after = {name: dict(rows) for name, rows in state.items()}
    for name, make in (("parents", parent), ("children", child)):
        for _ in range(rng.randrange(5)):
            key = rng.randrange(9)
            if rng.random() < 0.6:
                after[name][key] = make(rng, key)
            else:
                after[name].pop(key, None)
    return after


def batches(spark, before, after, local=False):
    out = {}
    for name, schema in (("parents", PARENT), ("children", CHILD)):
        keys = before[name].keys() | after[name].keys()
        changes = [(k, before[name].get(k), after[name].get(k)) for k in keys if before[name].get(k) != after[name].get(k)]
        if changes:
            out[name] = (frame_of(spark, changes, deltas.schema(schema, "id")) if local else spark.createDataFrame(changes, deltas.schema(schema, "id")))
    return out


def plan(rng):
    where = rng.choice([ir.Always(), ir.Cmp(ir.Col("r"), "<=", ir.Lit(1)), ir.Not(ir.Prefix(ir.Col("t"), "a")), ir.Or((ir.IsNull(ir.Col("n")), ir.Cmp(ir.Col("n"), ">", ir.Param(0))))])
    order = tuple(ir.Order(c, rng.random() < 0.5) for c in rng.sample(["n", "r", "t"], rng.randint(1, 2)))
    kids = ir.Query("children", rng.choice([ir.Always(), ir.IsNotNull(ir.Col("v"))]), (ir.Order("v", rng.random() < 0.5),), rng.randint(1, 3))
    related = (ir.Related("children", kids),) if rng.random() < 0.7 else ()
    return ir.Query("parents", where, order, rng.randint(1, 4), related, params=(1,)), rng.randint(0, 2)


def plain(rows):
    """Engine rows as the oracle's: dicts, children as lists of dicts."""
    out = []
    for _, r in rows:
        d = dict(zip(PARENT.names, r))
        if len(r) > len(PARENT):
            d["children"] = [x.asDict() for x in r[-1]]
        out.append(d)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_incremental_equals_from_scratch(spark, seed):
    rng = random.Random(seed)
    state = {"parents": {k: parent(rng, k) for k in range(rng.randrange(9))}, "children": {k: child(rng, k) for k in range(rng.randrange(9))}}
    query, slack = plan(rng)
    live = LiveList(compile_query(query, catalog()), slack)
    live.hydrate(frames(spark, state))
    assert plain(live.rows) == oracle.evaluate(query, rows_of(state), KEYS, RELATIONS)
    for n in range(4):
        after = transaction(rng, state)
        old = list(live.rows)
        live.apply(batches(spark, state, after, n % 2 == 1), frames(spark, after))
        want = oracle.evaluate(query, rows_of(after), KEYS, RELATIONS)
        assert plain(live.rows) == want, (seed, query)
        assert view.replay([r for _, r in old], view.positional_diff(old, live.rows)) == [r for _, r in live.rows]
        assert live.state_rows <= query.limit + max(slack, live.window.slack)
        state = after


def test_delta_algebra(spark):
    rng = random.Random(5)
    a = {k: parent(rng, k) for k in range(8)}
    b = transaction(rng, {"parents": a, "children": {}})["parents"]
    c = transaction(rng, {"parents": b, "children": {}})["parents"]
    make = lambda rows: spark.createDataFrame(list(rows.values()), PARENT)
    ab, bc = deltas.diff(make(a), make(b), "id"), deltas.diff(make(b), make(c), "id")
    key = lambda f: sorted(map(repr, f.collect()))
    assert key(deltas.apply(make(a), ab, "id")) == key(make(b))
    from pyspark.sql import functions as F

    both = deltas.compose(ab.withColumn("seq", F.lit(1)).unionByName(bc.withColumn("seq", F.lit(2))))
    assert key(both.select("key", "before", "after")) == key(deltas.diff(make(a), make(c), "id").select("key", "before", "after"))
    back = deltas.compose(ab.withColumn("seq", F.lit(1)).unionByName(deltas.diff(make(b), make(a), "id").withColumn("seq", F.lit(2))))
    assert back.count() == 0
    assert key(deltas.from_zset(deltas.to_zset(ab)).select("key", "before", "after")) == key(ab.select("key", "before", "after"))
    where = ir.Cmp(ir.Col("r"), ">", ir.Lit(0.5))
    kept = lambda rows: {k: r for k, r in rows.items() if oracle.test3(where, dict(zip(PARENT.names, r))) is True}
    assert key(deltas.filter_changes(ab, where).select("key", "before", "after")) == key(deltas.diff(make(kept(a)), make(kept(b)), "id").select("key", "before", "after"))
    assert all(r["before"] != r["after"] for r in deltas.project_changes(ab, ["t", "n"]).collect())


ISSUES = T.StructType([T.StructField(n, t) for n, t in (("id", T.LongType()), ("project_id", T.LongType()), ("priority", T.LongType()), ("closed", T.LongType()), ("title", T.StringType()))])
COMMENTS = T.StructType([T.StructField(n, t) for n, t in (("id", T.LongType()), ("issue_id", T.LongType()), ("created_at", T.LongType()), ("body", T.StringType()))])


def seeded(spark, path=None):
    """Five open issues of project 1, one of project 2, one closed; two comments each."""
    known = Catalog().add(Table("issues", ISSUES, "id")).add(Table("comments", COMMENTS, "id")).relate(Relation("comments", "issues", "comments", "id", "issue_id"))
    engine = Engine(spark, known, path)
    issues = [(i, 1, i * 10, 0, f"issue {i}") for i in range(1, 6)] + [(6, 2, 999, 0, "other"), (7, 1, 999, 1, "closed")]
    engine.load("issues", spark.createDataFrame(issues, ISSUES))
    engine.load("comments", spark.createDataFrame([(i * 10 + n, i, n, "words") for i in range(1, 8) for n in (1, 2)], COMMENTS))
    return engine


def flagship(k=3):
    where = ir.And((ir.Cmp(ir.Col("project_id"), "=", ir.Param(0)), ir.Cmp(ir.Col("closed"), "=", ir.Lit(0))))
    return ir.Query("issues", where, (ir.Order("priority", True),), k, (ir.Related("comments", ir.Query("comments", order=(ir.Order("created_at", True),), limit=1)),), params=(1,))


@pytest.mark.parametrize("on_disk", [False, True])
def test_engine_scenarios(spark, tmp_path, on_disk):
    from tidepool import errors as E

    engine = seeded(spark, str(tmp_path / "db") if on_disk else None)
    events = []
    engine.on_delta(events.append)
    with engine.subscribe(flagship()) as live:
        assert [r[0] for r in live.rows] == [5, 4, 3] and [r[-1][0]["id"] for r in live.rows] == [52, 42, 32]
        assert live.initial.changes[0] == view.Added(0, live.rows[0])
        shown = [c.row for c in live.initial.changes]
        steps = [
            [ir.Update("issues", 1, (("priority", 100),))],
            [ir.Delete("issues", 5)],
            [ir.Insert("comments", (900, 4, 50, "newest"))],
            [ir.Update("issues", 3, (("priority", None),)), ir.Update("issues", 3, (("title", "both count"),))],
            [ir.Insert("issues", (8, 1, 500, 0, "new")), ir.Update("issues", 8, (("title", "changed at once"),)), ir.Delete("comments", 42)],
            [ir.Update("comments", 900, (("issue_id", 1),))],
        ]
        for n, ops in enumerate(steps, 1):
            assert engine.mutate(ops) == n == engine.version
            fresh = engine.subscribe(flagship())
            assert live.rows == fresh.rows
            fresh.close()
        for e in events:
            assert e.subscription == live.number
            shown = view.replay(shown, e.changes)
        assert shown == live.rows and [e.version for e in events] == sorted(e.version for e in events)
        # Nothing on screen, nothing said; and a body without effect has no version.
        said = len(events)
        assert engine.mutate([ir.Update("issues", 6, (("title", "elsewhere"),))]) == 7 and len(events) == said
        assert engine.mutate([ir.Update("issues", 6, (("title", "elsewhere"),))]) == 7 and engine.mutate([]) == 7
        for bad, error in [
            ([ir.Delete("issues", 1), ir.Delete("issues", 999)], E.MutationError),
            ([ir.Update("issues", 1, (("nothing", 1),))], E.MutationError),
            ([ir.Update("issues", 1, (("id", 2),))], E.MutationError),
            ([ir.Insert("issues", (1, 2))], E.MutationError),
            ([ir.Delete("nowhere", 1)], E.MutationError),
            (["?"], E.UnsupportedOps),
        ]:
            with pytest.raises(error):
                engine.mutate(bad)
        assert engine.version == 7 and engine.store.lookup("issues", [1])
        assert engine.mutate([ir.Delete("issues", 1)], ("client", 1)) == 8 == engine.mutate([ir.Delete("issues", 1)], ("client", 1))
        stats = engine.stats()
        assert (stats.subscriptions, stats.view_rows, stats.version) == (1, len(live.rows), 8)
    assert engine.stats().subscriptions == 0
    engine.store.compact("issues")
    assert engine.store.dump("issues").count() == 6
    engine.close()
    with pytest.raises(E.Closed):
        engine.subscribe(flagship())


def test_deleting_the_top_reads_the_table_seldom(spark):
    engine = seeded(spark)
    for n in range(40):
        pass
    engine.mutate([ir.Insert("issues", (100 + n, 1, 1000 + n, 0, "x")) for n in range(40)])
    with engine.subscribe(flagship()) as live:
        for n in range(18):
            engine.mutate([ir.Delete("issues", live.rows[0][0])])
        assert [r[0] for r in live.rows] == [121, 120, 119]
        assert engine.stats().window_refills <= 2
        assert engine.degrade() >= 0 and len(live.live.window.rows) == 3
        engine.mutate([ir.Delete("issues", 121)])
        assert [r[0] for r in live.rows] == [120, 119, 118]


def test_unbounded_list_and_select(spark):
    engine = seeded(spark)
    with engine.subscribe(ir.Query("issues", order=(ir.Order("priority", True),), allow_unbounded=True)) as live:
        assert [r[0] for r in live.rows] == [6, 7, 5, 4, 3, 2, 1]
        engine.mutate([ir.Delete("issues", 7)])
        assert [r[0] for r in live.rows] == [6, 5, 4, 3, 2, 1]
    assert engine.query(ir.Query("issues", order=(ir.Order("priority"),), limit=2, select=("title",))).columns == ["title"]


def test_file_stream_converges(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidepool.streaming.feed import Feed, feed_schema

    engine = seeded(spark, str(tmp_path / "db"))
    table = engine.catalog.table("issues")
    with engine.subscribe(flagship()) as live:
        folder = tmp_path / "feed"
        rows = [[(1, "U", 1, (1, 1, 77, 0, "up")), (2, "D", 5, None)], [(3, "I", 9, (9, 1, 60, 0, "new")), (4, "U", 9, (9, 1, 5, 0, "down")), (5, "I", 5, (5, 1, 1, 0, "back"))]]
        for n, part in enumerate(rows):
            spark.createDataFrame(part, feed_schema(table)).coalesce(1).write.mode("append").parquet(str(folder))
            stream = spark.readStream.schema(feed_schema(table)).parquet(str(folder))
            feed = Feed(engine, "issues")
            query = feed.start(stream, str(tmp_path / f"ck"))
            query.awaitTermination()
            fresh = engine.subscribe(flagship())
            assert live.rows == fresh.rows
            fresh.close()
        assert engine.tables["issues"].where(F.col("id") == 9).first()["priority"] == 5
        assert [r[0] for r in live.rows] == [1, 4, 3]


def test_lists_beyond_the_broadcast_bound_are_the_same(spark, monkeypatch):
    rng = random.Random(17)
    state = {"parents": {k: parent(rng, k) for k in range(60)}, "children": {k: child(rng, k) for k in range(200)}}
    kids = ir.Query("children", order=(ir.Order("v", True),), limit=2)
    query = compile_query(ir.Query("parents", order=(ir.Order("r"),), limit=40, related=(ir.Related("children", kids),)), catalog())
    one = LiveList(query).hydrate(frames(spark, state))
    plan = lambda: lower.explain(lower.evaluate(query, frames(spark, state)))
    hinted = plan()
    monkeypatch.setattr(lower, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "BroadcastHashJoin" in hinted and "BroadcastHashJoin" not in plan()
        assert LiveList(query).hydrate(frames(spark, state)) == one
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_children_are_kept_from_changes_of_the_driver(spark):
    """Random changes of children against the plain evaluator, with little slack; ties and updates at the end of a window among them."""
    for seed in range(3):
        rng = random.Random(40 + seed)
        state = {"parents": {k: parent(rng, k) for k in range(5)}, "children": {k: child(rng, k) for k in range(25)}}
        where = rng.choice([ir.Always(), ir.Cmp(ir.Col("v"), ">", ir.Lit(-1))])
        kids = ir.Query("children", where, (ir.Order("v", seed % 2 == 0),), 2, select=("v", "id") if seed == 2 else ())
        query = ir.Query("parents", order=(ir.Order("t"),), limit=4, related=(ir.Related("children", kids),))
        live = LiveList(compile_query(query, catalog()), 1)
        live.hydrate(frames(spark, state))
        for _ in range(8):
            after = {name: dict(rows) for name, rows in state.items()}
            for _ in range(4):
                key = rng.randrange(30)
                if rng.random() < 0.5:
                    after["children"].pop(key, None)
                else:
                    after["children"][key] = child(rng, key)
            live.apply(batches(spark, state, after, True), frames(spark, after))
            fresh = LiveList(compile_query(query, catalog()), 1).hydrate(frames(spark, after))
            assert live.rows == fresh
            state = after


def test_a_new_child_reads_no_table(spark):
    engine = seeded(spark)
    with engine.subscribe(flagship()) as live:
        for n in range(3):
            engine.mutate([ir.Insert("comments", (900 + n, 4, 50 + n, "newest"))])
            assert live.rows[1][-1][0]["id"] == 900 + n
        for n in (2, 1, 0):
            engine.mutate([ir.Delete("comments", 900 + n)])
        assert live.rows[1][-1][0]["id"] == 42 and engine.stats().child_refills == 0
        engine.mutate([ir.Update("issues", 4, (("title", "said anew"),))])
        assert live.rows[1][4] == "said anew" and engine.stats().child_refills == 0
