"""Split CSV, written pages and joined level indexes."""

import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabulon.operators import encode
from tabulon.operators.indexing import IndexedForest, LevelIndex, one_hot_levels
from tabulon.operators.pages import PageIndex
from tabulon.sources.split_csv import read_split_csv, record_texts
from tabulon.sources.tables import CSV_FORM, clients, read_csv, write_csv

SCHEMA = "id long, text string, n double"


@pytest.fixture
def small_blocks(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "1000"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def texts(seed, n, longest):
    choose = random.Random(seed)
    parts = ["word ", "\n", "\n\n", '"', '""', ",", "\r\n", " ", "é", "\\N", "\\", "'"]
    for i in range(n):
        text = "".join(choose.choice(parts) for _ in range(choose.randint(0, longest)))
        yield i, choose.choice([text, text, text, None, "", " padded "]), choose.choice([None, i / 7])


@pytest.mark.parametrize("longest", [5, 60, 4000])
def test_blocks_give_the_rows_of_the_whole_file(spark, tmp_path, small_blocks, longest):
    rows = list(texts(longest, 300 if longest < 1000 else 12, longest))
    table = spark.createDataFrame(rows, SCHEMA)
    write_csv(table.coalesce(2), str(tmp_path / "t"))
    found = read_split_csv(spark, str(tmp_path / "t"), SCHEMA, CSV_FORM)
    key = lambda r: r[0]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(map(tuple, read_csv(spark, str(tmp_path / "t"), SCHEMA).collect()), key=key)
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path / "t"))
    assert lines.rdd.getNumPartitions() > 4  # so a file was cut


def test_records_without_header_and_empty_files(spark, tmp_path, small_blocks):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.csv").write_text('1,"a\nb"\n\n2,c\n3,"never closed\n4,x\n')
    (tmp_path / "a" / "2.csv").write_text("")
    got = sorted(r.record for r in record_texts(spark, str(tmp_path / "a"), header=False).collect())
    assert got == ['1,"a\nb"', "2,c", '3,"never closed\n4,x']


@pytest.mark.parametrize("rows_per_zone", [7, 1000])
def test_pages_by_place(spark, tmp_path, rows_per_zone):
    rows = [(i % 9 if i % 10 else None, f"t{i % 4}") for i in range(100)]
    df = spark.createDataFrame(rows, "k int, t string").repartition(3)
    index = PageIndex.build(df, "k", str(tmp_path / "p"), rows_per_zone)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert index.total() == 100
    for limit, offset in ((10, 0), (33, 41), (5, 97), (4, 100), (1000, 0)):
        assert [tuple(r) for r in index.page(limit, offset).collect()] == order[offset : offset + limit]
    for value in (0, 4, 8, 100, -1):
        assert index.rows_before(value) == sum(k is None or k < value for k, _ in rows)


def test_a_page_reads_only_its_zones(spark, tmp_path):
    index = PageIndex.build(spark.range(10_000).withColumnRenamed("id", "k"), "k", str(tmp_path / "p"), rows_per_zone=500)
    plan = index.page(10, 5_000)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "__id" in plan.split("PushedFilters")[1]
    assert "PartitionFilters: []" not in plan
    assert [r.k for r in index.page(10, 5_000).collect()] == list(range(5_000, 5_010))


def test_no_rows_have_no_pages(spark, tmp_path):
    index = PageIndex.build(spark.range(0).withColumnRenamed("id", "k"), "k", str(tmp_path / "p"))
    assert index.total() == 0 and index.page(10).count() == 0 and index.rows_before(3) == 0


def test_index_codes_equal_the_driver_held_ones(spark, base_dir, tmp_path):
    table = clients(spark, base_dir).select("client_id", "estado", "gp_renda")
    index = LevelIndex.fit(table, ["estado", "gp_renda"], str(tmp_path / "i"))
    new = table.withColumn("estado", F.when(F.col("client_id") % 7 == 0, "nowhere").otherwise(F.col("estado")))
    got = LevelIndex.load(spark, index.path).transform(new)
    want = encode.fit_frequency_index(table, ["estado", "gp_renda"]).transform(new)
    wanted = ["client_id", "estado_idx", "gp_renda_idx"]
    assert sorted(map(tuple, got.select(*wanted).collect())) == sorted(map(tuple, want.select(*wanted).collect()))


def test_forest_on_a_column_with_a_level_per_row(spark, tmp_path):
    data = spark.range(600).select(
        "id", F.concat(F.lit("u"), F.col("id")).alias("name"), (F.col("id") % 5).cast("double").alias("x"),
        (F.col("id") % 5 > 2).cast("double").alias("label"))
    fitted = IndexedForest.fit(data, ["name"], ["x"], str(tmp_path / "f"), numTrees=5, maxDepth=4, maxBins=32, featureSubsetStrategy="all")
    scores = IndexedForest.load(spark, str(tmp_path / "f")).score_table(data.withColumn("name", F.lit("unseen")), ["id", "label"])
    assert scores.where("prediction <> label").count() == 0
    assert fitted.score_table(data, ["id"]).count() == 600


def test_one_hot_of_many_levels(spark):
    df = spark.createDataFrame([(i, f"v{i % 40:02d}" if i % 9 else None) for i in range(200)], "id long, v string")
    rows = one_hot_levels(df, "v").select("id", "v", vector_to_array("v_onehot").alias("hot")).collect()
    levels = sorted({r.v for r in rows if r.v})
    assert len(rows) == 200 and all(r.hot == [float(r.v == level) for level in levels] for r in rows)
