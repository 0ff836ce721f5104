import random

from pyspark.sql import functions as F

from lectorium.session import checkpointed, row_numbers


def test_ranks_across_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randrange(50), i) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    got = row_numbers(df, ["k"], [F.col("v").desc(), F.col("i").asc()], "r").collect()
    assert len(got) == 700
    by = {}
    for k, v, i in rows:
        by.setdefault(k, []).append((-v, i))
    expected = {i: n for own in by.values() for n, (_, i) in enumerate(sorted(own), 1)}
    assert {r["i"]: r["r"] for r in got} == expected
    assert row_numbers(df.limit(0), ["k"], ["v"]).count() == 0
    assert sorted(r["row_number"] for r in row_numbers(df, [], ["i"]).collect()) == list(range(1, 701))


def test_checkpoint_cuts_lineage(spark):
    df = checkpointed(spark.range(5).withColumn("x", F.rand(1)))
    assert df.count() == 5 and sorted(map(tuple, df.collect())) == sorted(map(tuple, df.collect()))
    assert spark.sparkContext.getCheckpointDir()
