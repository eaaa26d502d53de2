from __future__ import annotations

from pyspark.sql import functions as F

from cairn.session import cut, shared_dir, spread


def test_shared_folder_and_cut(spark):
    assert shared_dir(spark) and spark.sparkContext.getCheckpointDir()
    df = cut(spark.range(10).withColumn("p", F.spark_partition_id()))
    assert "ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 10


def test_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    cores = spark.sparkContext.defaultParallelism
    assert spread(one).rdd.getNumPartitions() == cores and spread(one).count() == 100
    many = spark.range(0, 100, 1, cores + 3)
    assert spread(many) is many
    grouped = one.groupBy("id").count()
    assert spread(grouped) is grouped


def test_executors_need_not_have_the_package(tmp_path):
    """Python workers of a session started elsewhere, with the package on the driver's path only."""
    import os
    import subprocess
    import sys
    import textwrap

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {root!r})
        from cairn.operators.shredding import leaf_rows, shred
        from cairn.session import build_session
        spark = build_session(cores=1, spark__driver__memory="1g")
        df = spark.createDataFrame([(1, '{{"labs": [{{"x": 1}}, {{"x": 2}}]}}')], "k bigint, p string")
        print("rows", leaf_rows(shred(df, "k", "p", ["labs.x"]), "k", {{"labs": "x"}}, ["a", "b"]).count())
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 2" in done.stdout, done.stderr[-2000:]
