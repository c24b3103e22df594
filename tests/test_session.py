from pyspark.sql import functions as F

from tiltml.session import checkpoint_dir, cut_lineage, drop_scratch, materialize


def test_checkpoint_dir_reads_the_session_setting(spark):
    d = checkpoint_dir(spark)
    assert d and d == spark.sparkContext.getCheckpointDir()


def test_cut_lineage_and_materialize_keep_rows(spark):
    df = spark.range(1000).select((F.col("id") * 3).alias("x")).filter("x % 2 = 0")
    a = cut_lineage(df)
    b = materialize(df, "test")
    exp = sorted(r.x for r in df.collect())
    assert sorted(r.x for r in a.collect()) == exp
    assert sorted(r.x for r in b.collect()) == exp
    # the written table is a plain scan: no lineage back to the range/filter
    assert "Range" not in b._jdf.queryExecution().optimizedPlan().toString()


def test_cluster_session_without_checkpoint_dir_fails(monkeypatch, spark):
    import pytest

    import tiltml.session as S

    class FakeSC:
        master = "spark://cluster:7077"

        def getCheckpointDir(self):
            return None

    class FakeConf:
        def get(self, key, default=None):
            return default

    class FakeSpark:
        sparkContext = FakeSC()
        conf = FakeConf()

    with pytest.raises(RuntimeError):
        S.checkpoint_dir(FakeSpark())


def test_drop_scratch_deletes_what_was_written(spark, monkeypatch):
    import tiltml.session as S
    monkeypatch.setattr(S, "_SCRATCH", [])
    table = materialize(spark.range(5).toDF("x"), "dropped")
    folder = table.inputFiles()[0].rsplit("/", 1)[0]
    assert drop_scratch(spark) == 1 and drop_scratch(spark) == 0
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
