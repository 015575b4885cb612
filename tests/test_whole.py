"""Queries cover their whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane import catalog
from corvane.operators import ranking, targets
from corvane.query import table


def lineitems(spark, path, keys):
    rows = [(k, 1, 1, n, 1) for k in keys for n in (1, 2)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity int").write.parquet(f"{path}/lineitem.parquet")


def test_every_order_has_a_verdict(spark, tmp_path):
    keys = [1, 3999, 4000, 4001, 100_000]
    lineitems(spark, tmp_path, keys)
    rows = catalog.queries()["check_proof"](spark, str(tmp_path)).collect()
    assert sorted(r["id"] for r in rows) == keys
    assert len({(r["verified"], r["failed"], r["disposition"]) for r in rows}) == 1


def test_every_part_and_customer_has_a_row(spark, sf_dir):
    for name, of in (("rank_reordered", "part"), ("graph_freshness", "customer")):
        rows = catalog.queries()[name](spark, sf_dir)
        assert rows.count() == rows.select("file").distinct().count() == table(spark, sf_dir, of).count() > 80


def test_positions_need_no_window_over_all_rows(spark):
    rows = spark.range(1000).select(F.concat(F.lit("f"), "id").alias("file"), (F.col("id") * 37 % 1000).alias("lexical_rank"))
    ranked = rows.where("lexical_rank % 3 = 0").select("file", (-F.col("lexical_rank")).alias("rank"))
    got = {r["file"]: r["position"] for r in targets.reordered(rows, ranked.repartition(3)).collect()}
    keys = {r["file"]: r["lexical_rank"] for r in rows.collect()}
    order = sorted(keys, key=lambda f: (keys[f] % 3 > 0, -keys[f] if keys[f] % 3 == 0 else keys[f]))
    assert got == {f: i + 1 for i, f in enumerate(order)}
    out = ranking.numbered(rows, [F.asc("lexical_rank")], "n")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "Window [row_number" not in plan
    assert ranking.numbered(rows.limit(0), [F.asc("lexical_rank")], "n").count() == 0


def test_every_order_is_judged(spark, sf_dir, tmp_path):
    spark.createDataFrame([(1, 3), (3, 3), (7, 3)], "c_custkey bigint, c_nationkey bigint").write.parquet(f"{tmp_path}/customer.parquet")
    # no order's key is a multiple of four
    spark.createDataFrame([(13, 1), (26, 3), (53, 3), (33, 7)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["id"]: r["verdict"] for r in catalog.queries()["semantic_verdicts"](spark, str(tmp_path)).collect()}
    assert got == {1: "unresolved", 3: "contradicted", 7: "unavailable"}
    whole = catalog.queries()["semantic_verdicts"](spark, sf_dir)
    assert whole.select("verdict").distinct().count() == 5
