import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from locusframe.functions.numbers import exponential, fixed, js_number_text, number_text

TIES = [0.125, 1.005, 2.675, 0.015, 0.025, 0.045, 999.995, 12.345, -0.125, -1.005, 0.0005, 8.5]


def column(spark, values, function):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    rows = df.select("i", function(F.col("x")).alias("t")).orderBy("i").collect()
    return [row.t for row in rows]


def test_fixed_rounds_the_binary_value_like_python(spark):
    random.seed(5)
    values = TIES + [round(random.uniform(-200, 200), d) for d in (2, 3, 4, 5) for _ in range(2000)]
    assert column(spark, values, lambda x: fixed(x, 2)) == [f"{v:.2f}" for v in values]
    assert column(spark, values, lambda x: fixed(x, 3)) == [f"{v:.3f}" for v in values]


def test_fixed_rounds_ties_up_like_javascript(spark):
    values = [abs(v) for v in TIES]
    exact = [str(Decimal(v).quantize(Decimal("0.01"), ROUND_HALF_UP)) for v in values]
    assert column(spark, values, lambda x: fixed(x, 2, "up")) == exact


def test_fixed_of_zeros_keeps_the_sign_that_python_writes(spark):
    values = [-0.0, 0.0, -0.0001, -0.0005, -0.00049, 0.0001, -1e-300]
    for digits in (2, 3):
        texts = column(spark, values, lambda x: fixed(x, digits))
        assert texts == [f"{v:.{digits}f}" for v in values]
    # JavaScript writes no sign before a zero, but one before a number that is rounded to it.
    assert column(spark, values[:3], lambda x: fixed(x, 2, "up")) == ["0.00", "0.00", "-0.00"]


def test_fixed_of_missing_and_large_values(spark):
    assert column(spark, [None, 1e25, 5e-324], lambda x: fixed(x, 2)) == [
        None,
        "10000000000000000000000000.00",
        "0.00",
    ]


def test_number_text_is_python_repr(spark):
    random.seed(6)
    values = [1e-5, 1e-4, 1.2e-4, 1e7, 12345678.5, 1e15, 1e16, 1e300, 1e-300, 0.0, 5.0, -3.3e-5, 1e22]
    values += [round(random.uniform(0, 1000), 4) for _ in range(3000)]
    values += [1 / (1 + v * v) for v in range(1, 3000)]
    assert column(spark, values, number_text) == [repr(v) for v in values]


def test_number_text_of_javascript(spark):
    values = [5.0, 0.001, 1e-6, 1.5e-7, 1e21, 1e20, 123456789.5, -0.00025, 20.0, 0.0, None]
    assert column(spark, values, js_number_text) == [
        "5", "0.001", "0.000001", "1.5e-7", "1e+21", "100000000000000000000", "123456789.5",
        "-0.00025", "20", "0", None,
    ]


def test_exponential_pads_no_exponent(spark):
    values = [1.234e-5, 0.0, 12.3, 1e-120, None]
    assert column(spark, values, exponential) == [
        "1.23e-5", "0.00e+0", "1.23e+1", "1.00e-120", None,
    ]
