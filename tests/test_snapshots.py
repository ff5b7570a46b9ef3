from datetime import datetime as T

from claimweave.operators.snapshots import change_counts, snapshot_changes

A = """artifact_id bigint, repo_id string, head_sha string, commit_idx int, committed_at timestamp_ntz, delivered_at timestamp_ntz,
 edges array<struct<source_id string, target_id string, type string, confidence double, status string, evidence array<string>>>, seq string"""


def e(s, t="t", c=0.5, st="active"):
    return (s, t, "CALLS", c, st, None)


def test_changes(spark, rows):
    d = lambda k: T(2025, 1, k)
    data = [
        (1, "r", "s1", 1, d(1), d(1), [e("a"), e("b"), e("b"), e("gone")], "x"),
        (2, "r", "s2", 4, d(2), d(2), [e("zzz")], "x"),  # replaced by a later delivery
        (3, "r", "s2", 4, d(2), d(3), [e("b", c=0.500000001), e("a", c=0.6), e("new"), None, e("n", c=None)], "x"),
        (4, "r", "s3", 9, d(4), d(4), [], "x"),
        (5, "r", None, 10, d(5), d(5), [e("q")], "x"),
        (6, "r", "s4", 11, d(5), d(5), None, "x"),
        (7, "r", "s5", 12, d(6), d(6), [e("n", c=0.1)], "x"),
        (8, "other", "s1", 1, d(1), d(1), [e("a")], "x"),
    ]
    out = rows(snapshot_changes(spark.createDataFrame(data + data[:1], A)).select("repo_id", "head_sha", "source_id", "change_kind"))
    assert out == sorted(
        [("r", "s2", "a", "changed"), ("r", "s2", "gone", "removed"), ("r", "s2", "new", "added"), ("r", "s2", "n", "added"), ("r", "s3", "a", "removed"), ("r", "s3", "b", "removed"), ("r", "s3", "new", "removed"), ("r", "s3", "n", "removed"), ("r", "s5", "n", "added")], key=repr
    )
    counts = {r.head_sha: (r.n_added, r.n_removed, r.n_changed) for r in change_counts(spark.createDataFrame(data, A)).collect()}
    assert counts["s2"] == (2, 1, 1)


def test_null_against_number_and_empty(spark, rows):
    d = T(2025, 1, 1)
    data = [(1, "r", "a", 1, d, d, [e("x", c=None)], ""), (2, "r", "b", 2, d, d, [e("x", c=0.0)], ""), (3, "r", "c", 3, d, d, [e("x", c=0.0, st="rejected")], "")]
    assert [r[-1] for r in rows(snapshot_changes(spark.createDataFrame(data, A)))] == ["changed", "changed"]
    assert snapshot_changes(spark.createDataFrame([], A)).count() == 0
