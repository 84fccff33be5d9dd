import random

from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from verbena.operators.orphans import Child, OrphanTracker, orphan_report, orphan_rows, parents, track

CHILD = "id bigint, ref string, other string, t string, got timestamp_ntz, key string, valid_from int"
PARENT = "name string, born timestamp_ntz, gone timestamp_ntz, key int"


def make(spark, child, parent, fields=("ref",), **options):
    c = spark.createDataFrame(child, CHILD)
    p = spark.createDataFrame(parent, PARENT)
    return track([Child("c", c, "id", "t", "got", fields)], parents(p, "ref", "name", "born", "gone"), **options)


def ts(text):
    from datetime import datetime

    return datetime.fromisoformat(text) if text else None


def test_faults_keys_times_and_repeats(spark):
    parent = [("EXP-1 a", ts("2025-01-10T00:00"), None, 1), ("EXP-2", ts("2025-01-01T00:00"), ts("2025-06-01T00:00"), 2), ("EXP-2", ts("2025-01-01T00:00"), ts("2025-06-01T00:00"), 2), (None, ts("2025-01-01T00:00"), None, 3)]
    child = [
        (1, "exp_1__A", None, "2025-01-10T00:00:00", ts("2025-01-11T00:00"), "x", 0),  # at the birth: holds
        (2, "exp-1-a", None, "2025-01-09T23:59:59.999999Z", ts("2025-03-11T00:00"), "x", 0),
        (3, "EXP-2", None, "2025-05-31T19:00:00-06:00", ts("2025-07-11T00:00"), "x", 0),  # offset: 1 June
        (4, "EXP-2", None, "2025-05-31 23:59:59", ts("2025-07-11T00:00"), "x", 0),
        (5, "EXP-9", None, None, None, None, None),
        (6, None, None, "2025-01-01", None, None, None),
        (7, "EXP-1 A", None, "no time", None, None, None),
        (5, "EXP-9", None, None, None, None, None),
    ]
    tracker, _ = make(spark, child, parent)
    assert rows(orphan_rows(tracker)) == [("c", "deleted", "ref", 3), ("c", "late", "ref", 2), ("c", "missing", "ref", 5)]
    assert rows(orphan_report(tracker)) == sorted([("c", "deleted", "2025-06", 1, "ref"), ("c", "late", "2025-01", 1, "ref"), ("c", "missing", None, 1, "ref")], key=repr)


def test_empty_tables(spark):
    tracker, shots = make(spark, [], [], snapshots=True)
    assert orphan_rows(tracker).count() == 0 and shots.count() == 0
    tracker, _ = make(spark, [(1, "a", None, None, None, None, None)], [])
    assert rows(orphan_rows(tracker)) == [("c", "missing", "ref", 1)]
    tracker, _ = make(spark, [], [("a", ts("2025-01-01T00:00"), None, 1)])
    assert orphan_rows(tracker).count() == 0


REF = "child_table string, ref_field string, row_id bigint, key string, ref_time bigint, arrived bigint"
BORN = "ref_field string, key string, parent_id bigint, valid_from bigint"
GONE = "ref_field string, key string, parent_id bigint, valid_to bigint"


def events(spark, refs=(), born=(), gone=()):
    return [spark.createDataFrame([("c", "f", *x, 0) for x in refs], REF), spark.createDataFrame([("f", *x) for x in born], BORN), spark.createDataFrame([("f", *x) for x in gone], GONE)]


def faults(t):
    return {r.row_id: r.fault for r in t.found().collect()}


def test_state_resolves_and_reopens(spark):
    t = OrphanTracker(spark)
    t.advance(*events(spark, [(1, "a", 10), (2, "b", 10), (3, "b", 90)], [("b", 1, 5)]))
    assert rows(t.snapshot(1).select("fault", "n_refs")) == [("missing", 1)]
    t.advance(*events(spark, born=[("a", 2, 7)]))  # the parent arrives and is old enough
    assert faults(t) == {}
    t.advance(*events(spark, gone=[("b", 1, 50)]))  # the deletion reopens the later reference only
    assert faults(t) == {3: "deleted"}


def test_keys_with_several_lives(spark):
    t = OrphanTracker(spark)
    t.advance(*events(spark, [(1, "a", 10), (2, "a", 60)], [("a", 1, 20)]))
    assert faults(t) == {1: "late"}
    t.advance(*events(spark, gone=[("a", 1, 50)]))
    assert faults(t) == {1: "late", 2: "deleted"}
    t.advance(*events(spark, [(3, "a", 80)], [("a", 2, 5)]))  # registered again, from earlier on and without end
    assert faults(t) == {}
    t.advance(*events(spark, gone=[("a", 2, 70), ("z", 9, 5)]))  # z is withdrawn before it arrives
    assert faults(t) == {3: "deleted"}
    t.advance(*events(spark, [(4, "z", 7)], [("z", 9, 1)]))
    assert faults(t) == {3: "deleted", 4: "deleted"}


def test_large_index_and_resumed_state(spark, tmp_path, monkeypatch):
    from verbena.operators import orphans

    monkeypatch.setattr(orphans, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(orphans, "COMPACT", 2)
    folder = str(tmp_path / "state")
    t = OrphanTracker(spark, folder=folder)
    t.advance(*events(spark, [(1, "a", 10), (2, "b", None), (3, "c", 30)], [("a", 1, 5), ("c", 2, 40)]))
    t = OrphanTracker.resume(spark, folder)
    t.advance(*events(spark, [(4, "a", 90)], [("b", 3, 50)], [("a", 1, 60)]))
    t = OrphanTracker.resume(spark, folder)
    assert t.step == 2 and faults(t) == {3: "late", 4: "deleted"}
    t.advance(*events(spark, born=[("c", 4, 1)], gone=[("a", 1, 7)]))
    assert faults(OrphanTracker.resume(spark, folder)) == {1: "deleted", 4: "deleted"}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10_000), st.sampled_from([20, 60, 1000]), st.booleans())
def test_any_batches_give_the_same(spark, seed, days, snapshots):
    from datetime import datetime, timedelta

    rnd = random.Random(seed)
    day = lambda k: datetime(2025, 1, 1) + timedelta(days=k)
    lives = [(f"k{rnd.randrange(6)}", rnd.choice([None, rnd.randrange(250)]), rnd.choice([None, rnd.randrange(300)])) for _ in range(10)]
    child = [(i, f"K{rnd.randrange(8)}", None, day(k).isoformat() if (k := rnd.choice([None, rnd.randrange(300)])) is not None else None, rnd.choice([None, day(rnd.randrange(400)), datetime(1900, 1, 1), datetime(9000, 1, 1)]), None, None) for i in range(60)]
    opt = lambda k: None if k is None else day(k)
    tracker, _ = make(spark, child, [(k, opt(a), opt(b), 0) for k, a, b in lives + lives[:2]], period_days=days, snapshots=snapshots)
    want = []
    for i, ref, _, t, *_ in child:
        mine = [(a, b) for k, a, b in lives if k == ref.lower()]
        if not mine:
            want.append(("c", "missing", "ref", i))
        elif t is not None and all(a is not None for a, _ in mine) and t < day(min(a for a, _ in mine)).isoformat():
            want.append(("c", "late", "ref", i))
        elif t is not None and all(b is not None for _, b in mine) and t >= day(max(b for _, b in mine)).isoformat():
            want.append(("c", "deleted", "ref", i))
    assert rows(orphan_rows(tracker)) == sorted(want, key=repr)
