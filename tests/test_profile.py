"""Profiles and distributions against pandas and numpy."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from tabulon.operators import distribution, profile
from tabulon.operators.quantiles import exact_quantiles

PROBS = {"p0": 0.0, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    n = 3_000
    pdf = pd.DataFrame({
        "g": rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1]),
        "x": np.round(rng.lognormal(0, 3, n), 3),
        "k": rng.integers(0, 4, n),
        "y": rng.normal(size=n),
    })
    pdf.loc[rng.random(n) < 0.05, "y"] = np.nan
    pdf.loc[rng.random(n) < 0.33, "x"] = 1.25  # a third of the rows share a value
    return pdf


@pytest.fixture(scope="module")
def table(spark, frame):
    return spark.createDataFrame(frame)


# a coarse sketch makes brackets, slices and gaps all occur on few rows
@pytest.mark.parametrize("accuracy,slices", [(10_000, 4_096), (50, 8), (50, 1), (20, 64)])
def test_quantiles_are_exact(table, frame, accuracy, slices):
    spread = table.repartition(23) if slices == 64 else table.orderBy("x")
    got = exact_quantiles(spread, ["x", "k", "y"], PROBS, by=["g"], accuracy=accuracy, slices=slices).collect()
    assert len(got) == 9
    for row in got:
        values = frame.loc[frame.g == row.g, row["column"]].dropna()
        assert row.n == len(values)
        for name, p in PROBS.items():
            assert row[name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e9, 1e9) | st.sampled_from([0.0, 1.0]), min_size=1, max_size=200))
def test_quantiles_of_any_numbers(spark, values):
    table = spark.createDataFrame([(v,) for v in values], "v double")
    row = exact_quantiles(table, ["v"], PROBS, accuracy=25, slices=4).first()
    for name, p in PROBS.items():
        assert row[name] == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-6)


def test_describe(table, frame):
    want = frame.describe()
    # many partitions, so that the salted parts are merged
    got = {r["column"]: r for r in profile.describe(table.repartition(37)).collect()}
    assert set(got) == {"x", "k", "y"}
    for c, row in got.items():
        assert row["count"] == want[c]["count"]
        for ours, theirs in zip(["mean", "std", "min", "q25", "q50", "q75", "max"], ["mean", "std", "min", "25%", "50%", "75%", "max"]):
            assert row[ours] == pytest.approx(want[c][theirs])


def test_describe_of_a_column_without_values(spark):
    table = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    got = {r["column"]: (r["count"], r["mean"], r["std"]) for r in profile.describe(table).collect()}
    assert got == {"a": (2, 1.5, pytest.approx(0.5 ** 0.5)), "b": (0, None, None)}


def test_correlation_is_pairwise_complete(spark, frame):
    data = frame[["x", "k", "y"]].assign(flat=1.0)
    want = data.corr()
    for r in profile.correlation_matrix(spark.createDataFrame(data)).collect():
        if np.isnan(want.loc[r.x, r.y]):
            assert r.r is None
        else:
            assert r.r == pytest.approx(want.loc[r.x, r.y])


def test_mode_takes_smallest_of_ties(spark):
    rows = [(10, "b"), (9, "a"), (10, "a"), (9, "b"), (None, None), (None, None), (None, None)]
    got = {r["column"]: (r["mode"], r["count"]) for r in profile.modes(spark.createDataFrame(rows, "n int, s string")).collect()}
    assert got == {"n": ("9", 2), "s": ("a", 2)}


def test_value_counts_drop_null(spark):
    table = spark.createDataFrame([("a", 1), ("a", None), (None, 1)], "s string, n int")
    got = {(r["column"], r.value): r["count"] for r in profile.value_counts(table).collect()}
    assert got == {("s", "a"): 2, ("n", "1"): 2}


def test_duplicates_treat_nulls_as_equal(spark):
    table = spark.createDataFrame([(1, None), (1, None), (1, "a"), (None, None), (None, None), (None, None)], "n int, s string")
    assert profile.duplicate_count(table).first()[0] == 3
    assert profile.drop_duplicates(table).count() == 3
    assert profile.duplicate_count(table.limit(0)).first()[0] == 0


def test_kinds(spark):
    table = spark.createDataFrame([("1",), ("-2",), ("1.5",), (".5e3",), ("x",), (None,), ("",)], "v string")
    got = {r.kind: r["count"] for r in profile.kind_census(table).collect()}
    assert got == {"int": 2, "float": 2, "text": 2, "null": 1}


def test_column_info(table):
    rows = profile.column_info(table).orderBy("position").collect()
    assert [r["column"] for r in rows] == ["g", "x", "k", "y"]
    assert all(r.non_null + r.missing == 3_000 for r in rows)


def test_histogram_matches_numpy(table, frame):
    for column in ("x", "y", "k"):
        values = frame[column].dropna()
        counts, edges = np.histogram(values, bins=30)
        rows = distribution.histogram(table, column).orderBy("bin").collect()
        assert [r["count"] for r in rows] == counts.tolist()
        assert [r.low for r in rows] == pytest.approx(edges[:-1])


def test_histogram_of_constant_and_empty(spark):
    same = spark.createDataFrame([(2.0,)] * 5, "v double")
    rows = distribution.histogram(same, "v", bins=4).orderBy("bin").collect()
    assert [r["count"] for r in rows] == np.histogram([2.0] * 5, bins=4)[0].tolist()
    assert distribution.histogram(same.limit(0), "v").count() == 0


def test_density_is_the_kernel_sum(table, frame):
    values = frame.y.dropna().to_numpy()
    h = values.std(ddof=1) * len(values) ** -0.2
    for r in distribution.density(table, "y", points=20).collect():
        want = np.exp(-(((r.x - values) / h) ** 2) / 2).sum() / (len(values) * h * np.sqrt(2 * np.pi))
        assert r.density == pytest.approx(want)


def test_box_of_skewed_groups(table, frame):
    rows = {r.g: r for r in distribution.box_stats(table, "g", "x").collect()}
    for g, part in frame.groupby("g"):
        q1, q3 = np.quantile(part.x, [0.25, 0.75])
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = part.x[(part.x >= low) & (part.x <= high)]
        row = rows[g]
        assert row.outliers == len(part) - len(inside)
        assert row.whisker_low == min(inside.min(), q1)
        assert row.whisker_high == max(inside.max(), q3)


def test_cross_table_has_zero_cells(spark):
    table = spark.createDataFrame([("a", 0), ("a", 0), ("b", 1), (None, 1)], "s string, y int")
    got = {r.s: (r["0"], r["1"]) for r in profile.cross_table(table, "s", "y", [0, 1]).collect()}
    assert got == {"a": (2, 0), "b": (0, 1)}
    assert profile.count_table(table, "s", "y").count() == 2
