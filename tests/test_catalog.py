import pytest

from orderflow import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_sql(spark, same, name):
    same(catalog.queries()[name](spark, SF), catalog.oracle_sql()[name], SF)


def test_nothing_is_dropped(spark):
    from orderflow.fixtures import view
    from orderflow.operators import queue

    rows = view(spark, SF, "f1_queue")
    ok, rejected = queue.validate_queue(rows)
    assert ok.count() + rejected.count() == rows.count()
    records = catalog.flagship(spark, SF)
    assert {r[0] for r in records.selectExpr("length(registro)").distinct().collect()} == {400}


def test_streams_replay_alike(spark, tmp_path):
    from orderflow.fixtures import view
    from orderflow.streaming import push

    view(spark, SF, "f9_history").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    push.number_pushes(stream.drop("push"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == spark.read.parquet(f"{tmp_path}/in").count()
    assert out.filter("push > 0 AND no_historico").count() > 0
