"""Plan helpers: broadcast only under the bound; spread only small batch inputs."""

from pyspark.sql import functions as F

from lumenvec.plans.strategy import bounded_broadcast, spread


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bounded_broadcast_respects_bound(spark):
    big = spark.range(1000).withColumnRenamed("id", "k")
    small = spark.range(10).withColumnRenamed("id", "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hinted = big.join(bounded_broadcast(small, known_rows=10, max_rows=100), "k")
        assert "BroadcastHashJoin" in plan(hinted)
        refused = big.join(bounded_broadcast(small, known_rows=10, max_rows=5), "k")
        assert "BroadcastHashJoin" not in plan(refused)
        assert "BroadcastHashJoin" not in plan(big.join(bounded_broadcast(small), "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_spread_only_where_files_give_few_tasks(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text")
    assert "REPARTITION_BY_NUM" in plan(spread(docs, "doc_id"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        many = spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text", "lang")
        assert "REPARTITION_BY_NUM" not in plan(spread(many, "doc_id"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    stream = spark.readStream.format("rate").load().select(F.col("value").alias("doc_id"))
    assert spread(stream, "doc_id") is stream


def test_checkpoint_folder_without_a_preset(spark, monkeypatch):
    from lumenvec import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

        def setCheckpointDir(self, d):
            self.folder = d

    class Session:
        conf, sparkContext = Conf(), Context()

    import pytest

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
    Session.sparkContext.master = "local[2]"
    d = session.ensure_checkpoint_dir(Session())
    assert Session.sparkContext.folder == d
