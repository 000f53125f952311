"""Statistics and pages: null labels, empty tables and page borders."""

import pytest

from tabulon.operators import statistics

SCHEMA = "client_id int, estado string, faixa_etaria string, gp_renda string, adesao int"
ROWS = [
    (1, "SP", "18-24", "Alta", 1), (2, "SP", "18-24", "Baixa", 0), (3, "SP", None, "Alta", None),
    (4, "RJ", "25-34", None, None), (5, None, "25-34", "Alta", 1), (6, None, "65+", "Alta", 1),
]


@pytest.fixture(scope="module")
def clients(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_unlabelled_rows_count_as_non_adopters_overall(clients):
    assert tuple(statistics.overall(clients).first()) == (6, 3, 3, 50.0, 2)


def test_unlabelled_rows_are_left_out_by_state(clients):
    got = {r.estado: (r.aderiu, r.nao_aderiu, r["count"]) for r in statistics.by_state(clients).collect()}
    assert got == {"SP": (1, 1, 2), "RJ": (None, None, None), None: (2, 0, 2)}


def test_one_scan_gives_all_sections(clients):
    rows = statistics.all_statistics(clients).collect()
    section = {s: [r for r in rows if r.section == s] for s in ("state", "age", "income_label", "overall")}
    assert {(r.estado, r.aderiu, r.nao_aderiu, r["count"]) for r in section["state"]} == {
        ("SP", 1, 1, 2), ("RJ", None, None, None), (None, 2, 0, 2),
    }
    assert {(r.faixa_etaria, r["count"]) for r in section["age"]} == {
        ("18-24", 2), (None, 1), ("25-34", 2), ("65+", 1),
    }
    assert {(r.gp_renda, r.adesao, r["count"]) for r in section["income_label"]} == {
        ("Alta", 1, 3), ("Baixa", 0, 1), ("Alta", None, 1), (None, None, 1),
    }
    (total,) = section["overall"]
    assert (total["count"], total.aderiu, total.nao_aderiu, total.taxa_adesao, total.label_missing) == (6, 3, 3, 50.0, 2)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tuple(statistics.overall(empty).first()) == (0, 0, 0, 0.0, 0)
    (row,) = statistics.all_statistics(empty).collect()
    assert (row.section, row["count"], row.taxa_adesao, row.aderiu) == ("overall", 0, 0.0, 0)
    record = statistics.page_record(empty, "client_id").first()
    assert (record.total_records, record.returned_records, record.data) == (0, 0, [])


def test_statistics_record_is_nested(clients):
    record = statistics.statistics_record(clients).first()
    assert tuple(record.geral) == (6, 3, 3, 50.0)
    assert len(record.por_estado) == 3 and len(record.por_faixa_etaria) == 4 and len(record.por_renda) == 4


def test_pages_cover_every_row_once(clients):
    seen = []
    for offset in range(0, 8, 4):
        seen += [r.client_id for r in statistics.page(clients, "client_id", 4, offset).collect()]
    assert seen == [1, 2, 3, 4, 5, 6]
    assert statistics.page(clients, "client_id", 2, 9).collect() == []
    assert [r.client_id for r in statistics.page_after(clients, "client_id", 4, 10).collect()] == [5, 6]


def test_pages_of_repeated_keys_never_overlap(spark, monkeypatch):
    monkeypatch.setattr(statistics, "SPAN", 3)
    rows = [(i % 5 if i % 7 else None, f"t{i:03d}") for i in range(100)]
    table = spark.createDataFrame(rows, "k int, t string").repartition(7)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for limit, offset in ((10, 0), (10, 10), (30, 95), (7, 33), (1, 99), (200, 0), (5, 100)):
        assert [tuple(r) for r in statistics.page(table, "k", limit, offset).collect()] == want[offset : offset + limit]


def test_page_record(clients):
    record = statistics.page_record(clients, "client_id", limit=2, offset=3).first()
    assert (record.total_records, record.returned_records) == (6, 2)
    assert tuple(record.statistics) == (6, 3, 3, 50.0)
    assert [r.client_id for r in record.data] == [4, 5]


def test_top_breaks_ties_by_name(spark):
    table = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "name string, score double")
    assert [r.name for r in statistics.top(table, "score", "name").collect()] == ["c", "a", "b"]
    assert [r.name for r in statistics.top(table, "score", "name", 2).collect()] == ["c", "a"]
