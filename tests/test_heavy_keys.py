import datetime as dt

from pyspark.sql import Row

from twinsift.operators.heavy_keys import newest_per_content_key

T0 = dt.datetime(2025, 1, 1)
T1 = dt.datetime(2025, 2, 1)
A, B = "0123456789abcdef" * 2, "fedcba9876543210" * 2
SCHEMA = "file_id long, size long, quick_hash string, mtime double, scanned_at timestamp_ntz, extra string"


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return sorted(map(tuple, newest_per_content_key(df).collect()))


def test_ties_versions_and_readings(spark):
    rows = [
        (1, 10, A, 100.0, T0), (2, 10, f"md5:{A.upper()} ", 200.0, T0), (3, 10, "-".join([A[:8], A[8:]]), 200.0, T0),
        (4, 10, A, 300.0, T0), (4, 11, A, 300.0, T1),  # a later scan took it to another key
        (5, 20, B, None, T0), (6, 20, B, float("nan"), T0),  # no usable time
        (7, 30, B, 1.0, T0),  # alone
        (8, 0, A, 1.0, T0), (9, 0, A, 2.0, T0), (10, 40, "0" * 32, 1.0, T0), (11, 40, "0" * 32, 2.0, T0),
        (12, 50, A, 1e12, T0), (13, 50, A, 5.0, T0), (None, 50, A, 7.0, T0), (14, None, A, 7.0, T0), (15, 50, None, 9.0, None),
    ]
    assert found(spark, rows) == [(10, A, 2), (50, A, 13)]


def test_repeated_rows_and_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, 5, A, 1.0, T0)] * 5) == []
    assert found(spark, [(1, 5, A, 1.0, T0)] * 5 + [(2, 5, A, 2.0, T0)]) == [(5, A, 2)]


def test_one_key_with_most_rows_is_merged_before_the_shuffle(spark):
    df = spark.range(30_000).selectExpr("id as file_id", "1L as size", f"'{A}' as quick_hash", "cast(id as double) as mtime", "timestamp_ntz'2025-01-01' as scanned_at")
    out = newest_per_content_key(df)
    assert out.collect() == [Row(size=1, quick_hash=A, file_id=29_999)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "Window" not in plan
