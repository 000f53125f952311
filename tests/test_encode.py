"""Encodings against pandas, fitted state and large-table paths."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabulon.functions.expressions import (
    AGE_EDGES, AGE_LABELS, DIET_ORDER, decoded_one_hot, ordinal_code, right_closed_bin,
)
from tabulon.operators import bounded, encode


def test_age_bins_are_closed_on_the_right(spark):
    ages = [12.0, 13.0, 13.5, 17.0, 18.0, 23.0, 69.0, 70.0, 130.0, 131.0, None]
    table = spark.createDataFrame([(a,) for a in ages], "age double")
    want = pd.cut(pd.Series(ages), bins=AGE_EDGES, labels=AGE_LABELS, right=True)
    got = [r[0] for r in table.select(right_closed_bin(F.col("age"), AGE_EDGES, AGE_LABELS)).collect()]
    assert got == [None if pd.isna(w) else w for w in want]


def test_index_by_frequency_puts_null_and_unseen_last(spark):
    rows = [("b",), ("b",), ("c",), ("a",), (None,)]
    table = spark.createDataFrame(rows, "v string")
    fitted = encode.fit_frequency_index(table, ["v"])
    new = spark.createDataFrame([("b",), ("a",), ("c",), (None,), ("new",)], "v string")
    assert [r.v_idx for r in fitted.transform(new).collect()] == [0.0, 1.0, 2.0, 3.0, 3.0]
    coded = {r.v: r.c for r in encode.frequency_coded(table, "v", "c").collect()}
    assert coded == {"b": 0.0, "a": 1.0, "c": 2.0, None: 3.0}


def test_null_number_is_an_error(spark):
    table = spark.createDataFrame([(1.0, None)], "a double, b double")
    with pytest.raises(Exception):
        encode.assembled(table, ["a", "b"]).collect()


def test_label_codes_are_dense_and_null_is_last(spark):
    table = spark.createDataFrame([("b",), ("d",), (None,), ("b",)], "v string")
    got = {r.v: r.code for r in encode.label_encoded(table, "v", "code").collect()}
    assert got == {"b": 0, "d": 1, None: 2}


def test_unknown_ordinal_fails(spark):
    table = spark.createDataFrame([("Healthy",), ("Others",)], "v string")
    assert [r[0] for r in table.select(ordinal_code(F.col("v"), DIET_ORDER, "null")).collect()] == [2.0, None]
    with pytest.raises(Exception, match="unknown category: Others"):
        encode.ordinal_encoded(table, "v", DIET_ORDER, "code").collect()


def test_one_hot_matches_pandas(spark):
    pdf = pd.DataFrame({"id": range(5), "s": ["b", "a'x", None, "c d", "b"], "t": ["u", "u", "v", None, "v"]})
    table = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id int, s string, t string")
    for drop_first in (False, True):
        want = pd.get_dummies(pdf, columns=["s", "t"], dtype=int, drop_first=drop_first)
        got = encode.one_hot(table, ["s", "t"], drop_first=drop_first).orderBy("id")
        assert got.columns == list(want.columns)
        assert [list(r) for r in got.collect()] == want.to_numpy().tolist()


def test_unseen_level_has_no_indicator(spark):
    new = spark.createDataFrame([("z",), ("a",)], "s string")
    assert [tuple(r) for r in encode.one_hot(new, ["s"], {"s": ["a", "b"]}).collect()] == [(0, 0), (1, 0)]


def test_many_levels_use_vectors(spark):
    table = spark.createDataFrame([(f"v{i:02d}",) for i in range(30)] + [(None,)], "s string")
    assert encode.fit_levels(table, ["s"]) == {"s": [f"v{i:02d}" for i in range(30)]}
    vectors = encode.one_hot_vector(table, ["s"]).withColumn("a", vector_to_array("s_onehot")).collect()
    assert all(len(r.a) == 30 for r in vectors)
    assert {r.s: r.a.index(1.0) for r in vectors if r.s} == {f"v{i:02d}": i for i in range(30)}
    assert [sum(r.a) for r in vectors if r.s is None] == [0.0]


def test_alignment_orders_fills_and_drops(spark):
    table = spark.createDataFrame([(1, 2, 3)], "b int, a int, extra int")
    got = encode.aligned(table, ["a", "absent", "b"])
    assert got.columns == ["a", "absent", "b"] and tuple(got.first()) == (2.0, 0.0, 1.0)
    assert encode.unmatched_features(table, ["a", "absent"]) == ["absent"]


def test_one_hot_decoding(spark):
    table = spark.createDataFrame([(1, 0), (0, 1), (1, 1), (0, 0)], "`s_'x'` int, s_y int")
    names, columns = ["x", "y"], ["s_'x'", "s_y"]
    assert [r[0] for r in table.select(decoded_one_hot(columns, names)).collect()] == ["x", "y", "x", None]
    first = table.select(decoded_one_hot(columns, names, first_on_zero=True)).collect()
    assert [r[0] for r in first] == ["x", "y", "x", "x"]


def test_median_fill_takes_nan_as_missing(spark):
    table = spark.createDataFrame([(1.0,), (4.0,), (None,), (float("nan"),), (10.0,), (6.0,)], "x double")
    fitted = encode.fit_medians(table, ["x"])
    assert fitted == {"x": 5.0}
    assert [r.x for r in encode.median_filled(table, fitted).collect()] == [1.0, 4.0, 5.0, 5.0, 10.0, 6.0]


def test_preparation_matches_pandas(spark, tmp_path):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({
        "s": rng.choice(["a", "b", "c"], 60), "x": np.where(rng.random(60) < 0.2, np.nan, rng.normal(size=60)),
        "k": rng.integers(0, 5, 60), "y": np.where(rng.random(60) < 0.1, np.nan, rng.integers(0, 2, 60)),
    })
    table = spark.createDataFrame(pdf).withColumns({c: F.nanvl(c, F.lit(None)) for c in ("x", "y")})
    kept = pdf.dropna(subset=["y"])
    want = pd.get_dummies(kept, columns=["s"], drop_first=True)
    want = want.fillna(want.median(numeric_only=True)).astype(float)
    fitted = encode.TablePreparation.fit(table, "y")
    got = fitted.transform(table).toPandas().astype(float)
    assert list(got.columns) == list(want.columns)
    order = list(want.columns)
    np.testing.assert_allclose(
        got.sort_values(order).to_numpy(), want.sort_values(order).to_numpy()
    )
    fitted.save(spark, str(tmp_path / "p"))
    assert encode.TablePreparation.load(spark, str(tmp_path / "p")) == fitted


def test_new_rows_reuse_the_fitted_levels(spark):
    features = ["cgpa", "age_group_encoded", "dietary_encoded", "gender_Female", "gender_Male"]
    levels = {"gender": ["Female", "Male"]}
    new = spark.createDataFrame(
        [("18-24", "Healthy", "Male", 7.8), (None, "Moderate", "Other", 5.0)],
        "age_group string, dietary_habits string, gender string, cgpa double",
    )
    codes = {"18-24": 3, "25-34": 4, None: 5}
    got = [tuple(r) for r in encode.prepared_survey(new, features, codes, levels).collect()]
    assert got == [(7.8, 3.0, 2.0, 0.0, 1.0), (5.0, 5.0, 1.0, 0.0, 0.0)]


def test_feature_list_keeps_its_order(spark, tmp_path):
    names = [f"f{i}" for i in reversed(range(20))]
    encode.save_feature_list(spark, names, str(tmp_path / "f"))
    assert encode.load_feature_list(spark, str(tmp_path / "f")) == names


def test_large_tables_are_numbered_without_one_task(spark):
    table = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    for limit in (10, 5_000):
        rows = bounded.numbered(table, [F.desc("v")], "pos", max_rows=limit).collect()
        assert sorted((r.pos, r.v) for r in rows) == [(i, 999 - i) for i in range(1000)]


def test_large_fitted_table_is_checkpointed(spark):
    table, small = bounded.pin(spark.range(100), max_rows=10)
    assert not small and table.count() == 100
    table, small = bounded.pin(spark.range(10), max_rows=10)
    assert small and table.count() == 10


def test_small_join_matches_nulls(spark):
    left = spark.createDataFrame([(1, "a"), (2, None)], "id int, k string")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, v int")
    got = bounded.join_small(left, right, ["k"])
    assert got.columns == ["id", "k", "v"]
    assert sorted(tuple(r) for r in got.select("id", "v").collect()) == [(1, 10), (2, 20)]
