from pyspark.sql import functions as F

from hoopframe.plans import queries, sync_queries, views  # noqa: F401  sync_queries registers its queries

SF = "/root/testdata/sf0.1"  # 1,500 players score there


def test_two_options_asks_about_every_scorer(spark):
    points = views.actions(spark, SF).where("points > 0").groupBy("player_id").agg(F.sum("points"))
    got = queries.QUERIES["two_options"](spark, SF).collect()
    assert len(got) > 1000 and sorted((r.key, r.value) for r in got) == sorted(tuple(r) for r in points.collect())
