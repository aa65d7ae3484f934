import random

from pyspark.sql import functions as F

from voxloom.functions import columns as c


def test_rounding_is_by_the_exact_value(spark):
    rng = random.Random(3)
    values = [2.675, 4.015, 4.025, 0.005, 0.015, 0.145, 0.575, 1.005, 2.5, 3.5, 0.5, 0.0, 1e9 + 0.125]
    values += [k / 200 for k in range(1, 4001, 2)] + [k / 2000 for k in range(1, 4001, 2)] + [k / 20 for k in range(1, 2001, 2)]
    values += [rng.random() * 10 ** rng.randint(-3, 6) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 3):
        found = df.select("v", c.round_to(F.col("v"), digits).alias("r")).collect()
        assert [r.r for r in found] == [float(round(r.v, digits)) for r in found]


def test_sums_do_not_depend_on_order(spark):
    df = spark.createDataFrame([(v,) for v in [0.1] * 10 + [1e6, None, float("nan")]], "v double")
    assert df.select(c.exact_sum(F.col("v"))).first()[0] == 1000001.0
    assert df.where("false").select(c.exact_sum(F.col("v"))).first()[0] == 0.0
