"""Score models are joined and pivoted as columns: one row per unit moves, not one per unit and model."""

from cohortry.operators import reshape as rh
from cohortry.plans import views


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _tables(spark, path):
    spark.createDataFrame([(i, i % 3, "F" if i % 2 else "O", "1-URGENT", "1995-01-02") for i in range(8)],
                          "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string, o_orderdate string"
                          ).write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(i, "AUTO") for i in range(3)], "c_custkey bigint, c_mktsegment string").write.parquet(f"{path}/customer.parquet")
    spark.createDataFrame([(i % 6, 2.0 + i, 1500.0 * i, 0.01 * (i % 3)) for i in range(18)],
                          "l_orderkey bigint, l_quantity double, l_extendedprice double, l_discount double").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_predictions_unpivot_after_the_join(spark, tmp_path):
    sf = _tables(spark, tmp_path)
    pred = views.predictions(spark, sf)
    plan = _plan(pred)
    assert plan.index("Expand") < plan.index("Join")
    long = views.units(spark, sf).join(views.order_scores(spark, sf), "unit_id")
    assert pred.columns == long.columns and sorted(map(str, pred.collect())) == sorted(map(str, long.collect()))


def test_pivot_models_in_one_aggregation(spark):
    rows = [("a", "x", 1.0), ("a", "x", 1.0), ("a", "y", 2.0), ("b", "y", None), (None, "x", 3.0)]
    wide = rh.pivot_models(spark.createDataFrame(rows, "unit string, model string, score double"), ["unit"], ["x", "y"])
    assert _plan(wide).count("Aggregate") == 1
    assert {tuple(r) for r in wide.collect()} == {("a", 1.0, 2.0), ("b", None, None), (None, 3.0, None)}
