from datetime import datetime as T

from claimweave.operators.orphans import orphan_report, orphans

EDGES = "edge_id bigint, source_id string, target_id string, loaded_at timestamp_ntz, key string, days string"
NODES = "id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, key string"


def frames(spark, edges, nodes):
    return spark.createDataFrame([(*e, "x", "y") for e in edges], EDGES), spark.createDataFrame([(*n, "z") for n in nodes], NODES)


def test_reasons_periods_and_same_day(spark, rows):
    t = lambda h, d=1, m=3: T(2025, m, d, h)
    nodes = [("a", t(1), None), ("a", t(1), None), ("b", t(1), t(5)), ("b", t(9), None), ("c", t(12), None), (" d ", t(1), t(1)), (None, t(1), None)]
    edges = [
        (1, " a ", "b", t(2)),  # both live
        (2, "a", "b", t(6)),  # b deleted between its rows, on one day
        (3, "c", "nope", t(3)),  # late and missing
        (3, "c", "nope", t(3)),  # repeated
        (4, None, "  ", t(3)),  # no references
        (5, "d", "A", t(2, 2, 4)),  # never live; another case of letters
        (6, "b", "c", t(9)),  # live from its very second; late
    ]
    out = orphans(*frames(spark, edges, nodes))
    assert rows(out.drop("key")) == sorted([(2, "target", "deleted", "2025-03"), (3, "source", "late", "2025-03"), (3, "target", "missing", "2025-03"), (5, "source", "deleted", "2025-04"), (5, "target", "missing", "2025-04"), (6, "target", "late", "2025-03")], key=repr)


def test_hot_key_is_split_and_nothing_is_lost(spark, monkeypatch):
    import claimweave.runtime as rt

    monkeypatch.setattr(rt, "HEAVY_LEAST", 5)
    t = T(2025, 1, 1)
    edges = [(i, "hot", f"n{i}", t) for i in range(60)]
    nodes = [(f"n{i}", t, None) for i in range(0, 60, 2)] + [("hot", T(2025, 2, 1), None)]
    out = orphans(*frames(spark, edges, nodes)).groupBy("side", "reason").count().collect()
    assert {(r.side, r.reason): r["count"] for r in out} == {("source", "late"): 60, ("target", "missing"): 30}


def test_empty_tables_and_report(spark, rows):
    t = T(2025, 1, 1)
    assert orphans(*frames(spark, [], [("a", t, None)])).count() == 0
    e, n = frames(spark, [(1, "a", "b", t), (1, "a", "b", t), (2, "a", None, None)], [])
    assert rows(orphans(e, n).drop("key")) == [(1, "source", "missing", "2025-01"), (1, "target", "missing", "2025-01"), (2, "source", "missing", None)]
    full = {(r.side, r.period): (r.n_refs, r.n_missing, r.n_orphans) for r in orphan_report(*frames(spark, [(1, "a", "b", t), (1, "a", "b", t)], [("a", t, None)])).collect()}
    assert full == {("source", "2025-01"): (1, 0, 0), ("target", "2025-01"): (1, 1, 1)}
