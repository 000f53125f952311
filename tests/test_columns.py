"""Projections, names, validation and JSON rows on small tables."""

import datetime
import json

import pytest
from pyspark.sql import Row, functions as F

from tabulon.functions import expressions as ex
from tabulon.functions.names import CATEGORY_NAMES, FLAG_NAMES, to_table_names, with_underscore_names
from tabulon.operators import columns
from tabulon.sources.records import json_rows, parsed_json, records_table, typed_payload
from tabulon.sources.tables import read_csv, write_csv

RECORD = {**dict.fromkeys(CATEGORY_NAMES, "a"), **dict.fromkeys(FLAG_NAMES, 1)}


def test_missing_columns_are_named_before_any_job(spark):
    table = spark.range(1)
    with pytest.raises(ValueError, match="missing columns: a, b"):
        columns.require(table, ["a", "id", "b"])
    with pytest.raises(ValueError):
        columns.select_existing(table, ["nope"])


def test_select_keeps_the_listed_order(spark):
    table = spark.createDataFrame([(1, 2, 3)], "a int, `b c` int, d int")
    assert columns.select_existing(table, ["d", "x", "b c"]).columns == ["d", "b c"]
    assert columns.without(table, ["a", "x"]).columns == ["b c", "d"]


def test_membership_drops_null(spark):
    table = spark.createDataFrame([("a",), (None,), ("z",)], "v string")
    assert [r.v for r in columns.where_in(table, "v", ["a", "b"]).collect()] == ["a"]


def test_underscore_names_keep_accents(spark):
    table = spark.createDataFrame([("x", "y")], "`Gp score de crédito` string, Estado string")
    wide = with_underscore_names(table)
    assert wide.columns == ["Gp score de crédito", "Estado", "Gp_score_de_crédito"]
    assert wide.first()["Gp_score_de_crédito"] == "x"


def test_second_spelling_when_first_is_null_or_empty(spark):
    rows = [("new", "old"), ("", "old"), (None, "old"), (None, None)]
    table = spark.createDataFrame(rows, "Gp_renda string, `Gp renda` string")
    got = [r.gp_renda for r in to_table_names(table).collect()]
    assert got == ["new", "old", "old", None]


def test_nan_is_null_but_infinity_is_not(spark):
    table = spark.createDataFrame([(float("nan"), 1), (float("inf"), 2)], "x double, n int")
    assert [r.x for r in columns.nan_as_null(table).collect()] == [None, float("inf")]


def test_validation_reports_every_fault(spark):
    good = {k: str(v) for k, v in RECORD.items()}
    cases = [
        good, {**good, "Usa_pix": "1.0"}, {**good, "Usa_pix": "x", "Estado": None},
        {**good, "Usa_pix": "1.5"}, {**good, "Usa_pix": "9999999999"}, {**good, "Usa_pix": ""},
    ]
    schema = ", ".join(f"{c} string" for c in good)
    checked = columns.validated(spark.createDataFrame([tuple(c.values()) for c in cases], schema))
    reasons = [r.reject_reason for r in checked.collect()]
    assert reasons == [
        [], [], ["Estado: missing", "Usa_pix: not an integer"],
        ["Usa_pix: not an integer"], ["Usa_pix: not an integer"], ["Usa_pix: not an integer"],
    ]
    assert columns.accepted(checked).count() == 2
    assert columns.rejected(checked).count() == 4
    assert dict(checked.dtypes)["Usa_pix"] == "int"


def test_absent_field_is_missing(spark):
    checked = columns.validated(spark.createDataFrame([("a",)], "Estado string"))
    assert "Sexo: missing" in checked.first().reject_reason


def test_literal_records(spark):
    table = records_table(spark, [RECORD])
    assert table.count() == 1
    assert dict(table.dtypes)["Usa_app_banco"] == "int"
    assert not table.schema["Estado"].nullable


def test_parsed_and_typed_payloads(spark):
    table = spark.createDataFrame([(1, '{"a": 5, "b": "x"}')], "id int, body string")
    assert parsed_json(table, "body", "a int, b string").first() == Row(id=1, a=5, b="x")
    maps = spark.createDataFrame([(1, {"a": "5", "b": "x"})], "id int, m map<string,string>")
    assert typed_payload(maps, "m", {"a": "double", "b": "int", "c": "int"}).first() == Row(id=1, a=5.0, b=None, c=None)


def test_json_rows_cover_every_kind(spark):
    schema = (
        "t timestamp, d date, x double, raw binary, bad binary, m map<int, array<timestamp>>,"
        " s struct<y: float, z: decimal(5,2)>, n string, e struct<y: int>"
    )
    moment = datetime.datetime(2024, 1, 2, 3, 4, 5)
    exact = datetime.datetime(2024, 1, 2, 3, 4, 5, 600)
    from decimal import Decimal
    table = spark.createDataFrame(
        [(moment, moment.date(), float("nan"), b"abc", bytes([255, 1]), {7: [exact]}, (float("nan"), Decimal("1.50")), None, None)],
        schema,
    )
    assert json.loads(json_rows(table).first().json) == {
        "t": "2024-01-02T03:04:05", "d": "2024-01-02", "x": None, "raw": "abc", "bad": [255, 1],
        "m": {"7": ["2024-01-02T03:04:05.000600"]}, "s": {"y": None, "z": "1.50"}, "n": None, "e": None,
    }


def test_csv_round_trip_keeps_nulls_quotes_and_accents(spark, tmp_path):
    rows = [(1, "a,b", 1.5), (2, 'say "é"', None), (3, None, 0.1), (4, "x\\y", 2.0)]
    table = spark.createDataFrame(rows, "id int, `Gp renda` string, x double")
    write_csv(table, str(tmp_path / "t"))
    back = read_csv(spark, str(tmp_path / "t"), table.schema)
    assert sorted(tuple(r) for r in back.collect()) == rows
    inferred = read_csv(spark, str(tmp_path / "t"))
    assert inferred.dtypes == [("id", "int"), ("Gp renda", "string"), ("x", "double")]


def test_csv_round_trip_keeps_breaks_padding_and_empties(spark, tmp_path):
    rows = [(1, "a\nb"), (2, "  pad  "), (3, ""), (4, None), (5, "x\r\ny,\"q\"\\"), (6, "\t")]
    table = spark.createDataFrame(rows, "id int, s string")
    write_csv(table, str(tmp_path / "b"))
    assert sorted(tuple(r) for r in read_csv(spark, str(tmp_path / "b"), table.schema).collect()) == rows


def test_integers_are_plain_digits(spark):
    texts = ["1", "-2", "1.0", " 3 ", "1d", "1e0", "0x1", "1.5", "", "99999999999", None]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    got = {r.i: r.v for r in columns.validated(table, {"v": "int"}).collect()}
    assert [got[i] for i in range(len(texts))] == [1, -2, 1, 3, None, None, None, None, None, None, None]


def test_lone_empty_request_value_is_none(spark):
    table = spark.createDataFrame([("", 1)], "Estado string, Usa_pix int")
    row = to_table_names(table).first()
    assert row.estado is None and row.usa_pix == 1


def test_stored_table_without_key(spark):
    from tabulon.functions.names import from_stored_names
    table = spark.createDataFrame([("SP", 1), ("SP", 1), (None, 0)], "Estado string, Adesao_ao_OPF int")
    got = from_stored_names(table)
    assert got.columns == ["client_id", "estado", "adesao"]
    keys = {r.client_id for r in got.collect()}
    assert len(keys) == 3 and keys == {r.client_id for r in from_stored_names(table.repartition(3)).collect()}


def test_value_map_and_texts(spark):
    table = spark.createDataFrame([(1,), (0,), (2,), (None,)], "v int")
    got = table.select(
        ex.mapped(F.col("v"), {1: "Yes", 0: "No"}).alias("m"), ex.prediction_text(F.col("v")).alias("t")
    ).collect()
    assert [r.m for r in got] == ["Yes", "No", None, None]
    assert [r.t for r in got] == [ex.ADOPTS, ex.DECLINES, ex.DECLINES, ex.DECLINES]
