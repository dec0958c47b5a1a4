import pytest

from hoopframe import sql
from hoopframe.operators import reports, scope
from hoopframe.plans import views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('sql')}/actions"
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    derived = views.actions(spark, SF)
    derived.write.partitionBy("season_code").parquet(path)
    acts = spark.read.parquet(path)
    sql.register(spark, acts, views.starters(acts), views.players(spark, SF))
    yield spark
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_of_functions_reach_the_scan(session):
    text = plan(session.sql("select * from scorers('E2023', 5)"))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "PartitionFilters: [isnotnull(season_code" in scan and "E2023" in scan and "GreaterThan(points,0)" in scan
    assert "clock" not in scan.split("ReadSchema")[1]
    assert "TakeOrderedAndProject(limit=5" in text  # no task ranks them all
    text = plan(session.sql("select * from clutch_points('E2024', 5) where player_id = 'P1'"))
    assert "EqualTo(period,4th)" in text and "EqualTo(player_id,P1)" in text
    text = plan(session.sql("select * from scorers(null, 5)"))
    assert "PartitionFilters: []" in text


def test_functions_equal_the_library(session):
    acts = session.table("actions")
    want = reports.scorers(scope.in_scope(acts, "E2023")).collect()
    got = session.sql("select player_id, points, scoring_actions from scorers('E2023', 20) order by rank").collect()
    assert [tuple(r) for r in got] == [(r.player_id, r.points, r.scoring_actions) for r in want] and want


def test_scalar_functions(session):
    row = session.sql("select period_place('3rd') a, period_place('OT') b, period_place('3OT') c, period_place('x') d, shot_region('H', -650, 100) e, shot_region('E', 0, 0) f, shot_region(' ', 0, 0) g").first()
    assert tuple(row) == (3, 5, 7, 99, "left corner", "mid-range", None)


def test_functions_over_empty_tables(spark, session):
    acts = session.table("actions").limit(0)
    sql.register(spark, acts, views.starters(acts), views.players(spark, SF))
    for call in ("scorers(null, 5)", "shooting(null, 'Shot', null, 0)", "clutch_points('E2023', 5)", "passing_pairs(null, 3)", "points_with(null, 'P1')", "possessions_with('Assist')"):
        assert spark.sql(f"select * from {call}").collect() == []
