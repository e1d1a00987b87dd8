"""Characters in boxes."""

from reckon.operators import pages
from reckon.plans import pages as plans


def test_points_meet_the_boxes_that_hold_them(spark):
    points = spark.createDataFrame([(1, 1.0, 1.0), (1, 12.0, 9.0), (1, 20.0, 5.0), (2, 1.0, 1.0), (3, 1.0, 1.0), (1, None, 1.0)], "page int, x double, y double")
    boxes = spark.createDataFrame([(1, 0, 0.0, 0.0, 20.0, 10.0), (1, 1, 12.0, 9.0, 30.0, 11.0), (2, 0, 2.0, 0.0, 3.0, 9.0), (4, 0, 0.0, 0.0, 9.0, 9.0)], "page int, box int, x0 double, y0 double, x1 double, y1 double")
    got = pages.in_boxes(points, boxes, ["page"], 10.0).select("page", "box", "x").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1.0), (1, 0, 12.0), (1, 1, 12.0)]


def test_spread_boxes_are_never_broadcast(spark):
    """15,000 pages of 40 boxes of 9 cells look like 15,000 rows to Spark; broadcast, they filled the driver."""
    plan = plans.box_texts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    join = next(x for x in plan.split("\n") if "Join" in x)  # the outermost one
    assert "SortMergeJoin" in join and "cx" in join
    assert "Generate" not in plan.partition("LeftSemi")[2]
