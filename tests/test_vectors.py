from pyspark.sql import functions as F

from quillscope.functions import vectors as v
from quillscope.functions.arrays import longs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_walsh(spark):
    assert one(spark, v.walsh(longs([3, 1, 4, 1, 5, 9, 2, 6]))) == [31, -3, 5, -1, -13, 13, -7, -1]
    assert one(spark, v.walsh(v.walsh(longs([3, 1, 4, 1, 5, 9, 2, 6])))) == [8 * x for x in (3, 1, 4, 1, 5, 9, 2, 6)]
    assert one(spark, v.walsh(longs([1] * 8))) == [8] + [0] * 7
    assert one(spark, v.walsh(longs([1] + [0] * 7))) == [1] * 8
    assert one(spark, v.walsh(longs([0, 1] + [0] * 6))) == [1, -1] * 4
    big = [10**15, -(10**15)] * 4
    assert one(spark, v.walsh(v.walsh(longs(big)))) == [8 * x for x in big]


def test_algebra(spark):
    a, b = longs(list(range(1, 9))), longs(list(range(8, 0, -1)))
    assert one(spark, v.add(a, b)) == [9] * 8 and one(spark, v.sub(a, b)) == [-7, -5, -3, -1, 1, 3, 5, 7]
    assert one(spark, v.scale(a, 3)) == [3 * x for x in range(1, 9)]
    assert one(spark, v.is_zero(longs([0] * 8))) and not one(spark, v.is_zero(a))
    assert one(spark, v.detail_energy(v.walsh(longs([1] * 8)))) == 0
    assert one(spark, v.detail_energy(v.walsh(longs([10] + [0] * 7)))) == 70
    assert one(spark, v.l1_norm(longs([3, -1, 4, -1, 5, -9, 2, -6]))) == 31


def test_error_detect(spark):
    ref = [10, 50, 40, 30, 15, 20, 60, 5]
    assert tuple(one(spark, v.error_detect(longs(ref), longs(ref)))) == (-1, 0)
    for i in range(8):
        off = [x + 100 * (j == i) for j, x in enumerate(ref)]
        assert tuple(one(spark, v.error_detect(longs(off), longs(ref)))) == (i, 100)
        assert one(spark, v.correct(longs(off), F.lit(i), F.lit(ref[i]).cast("bigint"))) == ref
