from conftest import rows

from batchwright.operators import runs as R


def test_A10_ratio_of_means(spark):
    data = [("a", 1.0, 10, 5.0, 1.0, False), ("a", 4.0, 15, 7.0, 3.0, False), ("a", 99.0, 0, 0.0, 0.0, True), ("b", 0.0, 7, 1.0, 1.0, False)]
    df = spark.createDataFrame(
        data, "operation string, duration_s double, records_retrieved bigint, cpu_usage double, memory_usage_mb double, failed boolean"
    )
    want = [("a", 2.5, 12, 5.0, 6.0, 2.0), ("b", 0.0, 7, 0.0, 1.0, 1.0)]
    assert rows(R.summarize_runs(df, failed="failed")) == want
    assert rows(R.summarize_runs(df, failed="failed", scale=3)) == want


def test_A11_A12(spark):
    df = spark.createDataFrame([(1.5, 0.5, 100), (None, 0.5, 5), (0.0, 0.0, 7)], "insert_s double, read_s double, n bigint")
    got = R.throughput(R.phase_totals(df), "n", "total_s")
    assert [tuple(r)[3:] for r in got.collect()] == [(2.0, 50.0), (None, 0.0), (0.0, 0.0)]
    assert [r.w for r in R.throughput(df, "n", "insert_s", "w", whole=True).collect()] == [66, 0, 0]
