"""Queries under the operators' own cap of 32, on tables with services and calls around both caps."""

import __spark_entry__ as entry


def test_grpc_under_the_operators_cap(spark, tmp_path):
    size = {1: 4, 2: 5, 3: 32, 4: 33}
    parts = [(s * 100 + k, "B#", s) for s, n in size.items() for k in range(n)]
    spark.createDataFrame(parts, "p_partkey bigint, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k, 1) for k, *_ in parts], "l_partkey bigint, l_suppkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 7)], "s_suppkey bigint, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    got = entry.queries()["E25_grpc_cap32"](spark, str(tmp_path)).collect()
    assert {(r.call_id, r.op_id) for r in got if r.outcome == "matched"} == {(f"7:B#{s}", k) for k, _, s in parts if s < 4}
    assert [(r.call_id, r.op_id) for r in got if r.outcome != "matched"] == [("7:B#4", None)]


def test_fanout_guard_under_the_operators_cap(spark, tmp_path):
    size = {"four": 4, "five": 5, "most": 32, "more": 33}
    rows = [(k, f"e{k}", name, f"t{i}") for k, (name, i) in enumerate((name, i) for name, n in size.items() for i in range(n))]
    e = spark.createDataFrame(rows, "n bigint, edge_id string, source_id string, target_id string")
    e.selectExpr("edge_id", "source_id", "target_id", "'CALLS' AS type", "'r' AS repo_id", "0.9D AS confidence", "'active' AS status", "'x' AS detected_by", "timestamp'2026-01-01' AS loaded_at").write.parquet(f"{tmp_path}/edges.parquet")
    got = {r.call: (r.n_contracts, r.outcome) for r in entry.queries()["D10_fanout_guard_cap32"](spark, str(tmp_path)).collect()}
    assert got == {name: (n, "declined" if n > 32 else "matched") for name, n in size.items()}
