import random
from datetime import datetime
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from stallkeeper import oracle
from stallkeeper.functions import casts
from stallkeeper.functions.measures import days_between, month_start, percent, ratio

INTS = {
    "12": 12, " 12 ": 12, "+5": 5, "-7": -7, "007": 7, "": None, "  ": None, "12.5": None,
    "1e3": None, "x": None, "99999999999": None, "1 2": None, "\t12": None, "12\n": None, "٣": None,
}
MONEY = {
    "10.00": "10.00", "10": "10.00", " 3.5 ": "3.50", ".5": "0.50", "5.": "5.00", "-1.00": "-1.00",
    "+2.25": "2.25", "1.005": "1.01", "1e3": None, "n/a": None, "": None, ".": None, "1,5": None,
    "12345678901": None, "9999999999.99": "9999999999.99",
}
TIMESTAMPS = {
    "2017-10-02 10:56:33": datetime(2017, 10, 2, 10, 56, 33),
    "2017-10-02": datetime(2017, 10, 2),
    "2017-10-02 10:56:33.5": datetime(2017, 10, 2, 10, 56, 33, 500000),
    "2017-10-02 10:56": datetime(2017, 10, 2, 10, 56),
    "2017-10-02T10:56:33": datetime(2017, 10, 2, 10, 56, 33),
    " 2017-10-02": datetime(2017, 10, 2), "2017-10-02 ": datetime(2017, 10, 2),
    " 2017-10-02T10:56 ": datetime(2017, 10, 2, 10, 56),
    "2017-02-30": None, "2017-10": None, "2017": None, "not a date": None, "": None,
    "2017-10-02 25:00:00": None, "2017-10-02T": None, "2017-10-02 10": None,
    "2017-10-02\t": None, "2017-10-02\n": None, "2017-10-02  10:56": None,
}


def convert(spark, texts, conversion):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return {row.t: row.v for row in df.select("t", conversion(F.col("t")).alias("v")).collect()}


@pytest.mark.parametrize(
    ("conversion", "expected"),
    [
        (casts.to_int, INTS),
        (casts.to_money, {t: v and Decimal(v) for t, v in MONEY.items()}),
        (casts.to_timestamp, TIMESTAMPS),
    ],
)
def test_conversions(spark, conversion, expected):
    assert convert(spark, [*expected, None], conversion) == {**expected, None: None}


def test_conversions_agree_with_sql_on_random_text(spark):
    draw = random.Random(7)
    texts = sorted(
        {"".join(draw.choices("0123456789  +-.eE:", k=draw.randint(0, 7))) for _ in range(3000)}
        | {f"20{draw.randint(10, 99)}-{draw.randint(0, 14):02}-{draw.randint(0, 33):02}"
           for _ in range(300)}
        | {f"{draw.choice(['', ' '])}2017-10-02{draw.choice(' Tt')}"
           f"{''.join(draw.choices('0123:. ', k=draw.randint(0, 9)))}" for _ in range(300)}
        | {f"2017-10-02{draw.choice(' T')}1{draw.randint(0, 9)}:{draw.randint(10, 70)}{end}"
           for end in ("", ":05", ":05.25", ":5", " ", "  ", "Z") for _ in range(30)}
    )
    con = duckdb.connect()
    con.execute("CREATE TABLE texts (t VARCHAR)")
    con.executemany("INSERT INTO texts VALUES (?)", [(t,) for t in texts])
    for ours, theirs in (
        (casts.to_int, oracle._int),
        (casts.to_money, oracle._money),
        (casts.to_timestamp, oracle._timestamp),
    ):
        expected = dict(con.sql(f"SELECT t, {theirs('t')} FROM texts").fetchall())
        assert convert(spark, texts, ours) == expected


def test_days_are_midnights_crossed(spark):
    df = spark.createDataFrame(
        [(datetime(2017, 1, 1, 23, 59), datetime(2017, 1, 2, 0, 1))],
        "a timestamp_ntz, b timestamp_ntz",
    )
    assert df.select(days_between(F.col("a"), F.col("b"))).first()[0] == 1
    assert df.select(month_start(F.col("a")).alias("m")).dtypes == [("m", "date")]


def test_percent_is_rounded_once_from_decimals(spark):
    df = spark.createDataFrame([(1, 160, 3, 0)], "a long, b long, c long, zero long")
    got = df.select(
        percent(F.col("a"), F.col("b")),
        percent(F.col("a"), F.col("c")),
        percent(F.col("a"), F.col("zero")),
        ratio(F.col("b"), F.col("c")),
    ).first()
    assert list(got) == [Decimal("0.63"), Decimal("33.33"), None, Decimal("53.33")]
