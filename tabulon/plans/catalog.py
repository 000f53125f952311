"""Every operator as a named query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulon.functions.expressions import (
    DIET_ORDER, decoded_one_hot, mapped, prediction_text, quoted,
)
from tabulon.functions.names import (
    CATEGORIES, FLAGS, NAMES, OTHER_NAMES, from_stored_names, to_request_names, to_stored_names, to_table_names,
    with_underscore_names,
)
from tabulon.operators import boosting, columns, distribution, encode, metrics, profile, quantiles, split, statistics
from tabulon.operators.importance import global_importance, permutation_importance
from tabulon.operators.indexing import LevelIndex, one_hot_levels
from tabulon.operators.learners import feature_names
from tabulon.operators.pages import PageIndex
from tabulon.operators.scoring import FlatScorer, LightScorer, choose_scorer, score_records, scored
from tabulon.operators.trees import leaf_counts
from tabulon.plans import training
from tabulon.session import scratch_path
from tabulon.sources.models import load_model, read_metadata, save_model
from tabulon.sources.records import json_rows, parsed_json, typed_payload
from tabulon.sources.split_csv import read_split_csv
from tabulon.sources.tables import CSV_FORM, clients, read_csv, read_table, students, write_csv
from tabulon.streaming.scoring import read_records, score_stream

Query = Callable[[SparkSession, str], DataFrame]

SURVEY_COLUMNS = [
    "age", "gender", "dietary_habits", "sleep_duration", "suicidal_thoughts", "cgpa",
    "academic_pressure", "study_satisfaction", "depression",
]
SURVEY_NUMBERS = ["age", "cgpa", "academic_pressure", "study_satisfaction", "depression"]
# The survey model's listed features.
LISTED_FEATURES = [
    "academic_pressure", "cgpa", "study_satisfaction", "age_group_encoded", "dietary_encoded",
    "gender_Female", "gender_Male", "suicidal_thoughts_No", "suicidal_thoughts_Yes",
]
LIGHT_COLUMNS = ["estado", "faixa_etaria", "gp_renda", "renda", "usa_pix", "usa_ebanking", "usa_app_banco"]


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Float results rounded, as the order of a distributed sum varies."""
    return df.withColumns({n: F.round(quoted(n), digits) for n in names})


def survey(spark: SparkSession, base_dir: str) -> DataFrame:
    """Survey rows without their keys, as they are profiled."""
    return students(spark, base_dir).select(*SURVEY_COLUMNS)


def scored_students(spark: SparkSession, base_dir: str) -> DataFrame:
    """Label, a deterministic score, and the score cut at 45."""
    score = F.col("age") + F.col("academic_pressure")
    return students(spark, base_dir).select(
        "row_key", F.col("depression").alias("y"), score.alias("score"),
        F.when(score > 45, 1.0).otherwise(0.0).alias("p"),
    )


def raw_records(spark: SparkSession, base_dir: str) -> DataFrame:
    """Clients as text records under request names, some fields broken."""
    table = clients(spark, base_dir)
    key = F.col("client_id")
    text = table.select(
        key, *[quoted(c).cast("string").alias(c) for c in (*CATEGORIES, *FLAGS)]
    ).withColumns({
        "estado": F.when(key % 11 != 0, F.col("estado")),
        "usa_pix": F.when(key % 13 == 0, "yes").when(key % 19 == 0, "1d").when(key % 23 == 0, "1e0").otherwise(F.col("usa_pix")),
        "usa_cheque": F.when(key % 17 == 0, F.concat("usa_cheque", F.lit(".5"))).otherwise(F.col("usa_cheque")),
    })
    return to_request_names(text)


# --- statistics and pages --------------------------------------------------

def clients_page_totals(spark, base_dir):
    return statistics.page_with_totals(clients(spark, base_dir), "client_id", 25, 50)


def page_of_clients(spark, base_dir):
    table = columns.select_existing(clients(spark, base_dir), ["client_id", *statistics.PAGE_COLUMNS])
    return statistics.page(table, "client_id", 50, 100)


def deep_page(spark, base_dir):
    """A page far into rows whose key repeats, in full order."""
    rows = students(spark, base_dir).select("id", "row_key", "age")
    return statistics.page(rows, "id", 40, rows.count() // 2)


def stored_statistics(spark, base_dir):
    """All statistics of the client table in its stored spelling, without a key."""
    stored = to_stored_names(clients(spark, base_dir).drop("client_id")).withColumnsRenamed(
        {table: kept for kept, table in OTHER_NAMES.items()})
    return statistics.all_statistics(from_stored_names(stored))


def page_after_client(spark, base_dir):
    table = columns.select_existing(clients(spark, base_dir), ["client_id", *statistics.PAGE_COLUMNS])
    return statistics.page_after(table, "client_id", 80, 50)


def top_scores(spark, base_dir):
    return statistics.top(scored_students(spark, base_dir).select("row_key", "score"), "score", "row_key", 20)


def statistics_record(spark, base_dir):
    """The nested statistics record, taken apart into rows again."""
    record = statistics.statistics_record(clients(spark, base_dir)).persist()
    none = F.lit(None)

    def rows(part, name, label=none, count=none, aderiu=none, nao=none, rate=none):
        return [F.lit(part).alias("part"), name.alias("name"), label.cast("int").alias("adesao"), count.cast("long").alias("count"),
                aderiu.cast("long").alias("aderiu"), nao.cast("long").alias("nao_aderiu"), rate.cast("double").alias("taxa_adesao")]

    def entries(name):
        return record.select(F.explode(name).alias("e"))

    def of(field):
        return F.col(f"e.{field}")

    total = record.select(*rows("geral", none.cast("string"), none, *[F.col(f"geral.{f}") for f in ("total_clientes", "aderiu", "nao_aderiu", "taxa_adesao")]))
    state = entries("por_estado").select(*rows("estado", of("estado"), none, of("count"), of("aderiu"), of("nao_aderiu")))
    age = entries("por_faixa_etaria").select(*rows("faixa_etaria", of("faixa_etaria"), none, of("count")))
    income = entries("por_renda").select(*rows("renda", of("gp_renda"), of("adesao"), of("count")))
    return total.unionByName(state).unionByName(age).unionByName(income)


def page_record(spark, base_dir):
    """One record of a page with its totals, its rows taken apart again."""
    record = statistics.page_record(clients(spark, base_dir), "client_id", 25, 50)
    wanted = [c for c in statistics.PAGE_COLUMNS if c in clients(spark, base_dir).columns]
    return record.select("total_records", "returned_records", F.col("statistics.aderiu").alias("total_aderiu"),
                         F.col("statistics.taxa_adesao").alias("taxa_adesao"), F.explode("data").alias("row")).select(
        "total_records", "returned_records", "total_aderiu", "taxa_adesao", *[F.col(f"row.{c}").alias(c) for c in ["client_id", *wanted]])


STATISTICS: dict[str, Query] = {
    "statistics_record": statistics_record,
    "page_record": page_record,
    "stats_overall": lambda s, d: statistics.overall(clients(s, d)),
    "stats_by_state": lambda s, d: statistics.by_state(clients(s, d)),
    "stats_by_age": lambda s, d: statistics.count_by(clients(s, d), "faixa_etaria"),
    "stats_income_label": lambda s, d: statistics.count_by(clients(s, d), "gp_renda", "adesao"),
    "stats_all": lambda s, d: statistics.all_statistics(clients(s, d)),
    "table_shape": lambda s, d: statistics.table_shape(students(s, d)),
    "clients_page": page_of_clients,
    "clients_page_after": page_after_client,
    "deep_page": deep_page,
    "stored_statistics": stored_statistics,
    "clients_page_totals": clients_page_totals,
    "first_row": lambda s, d: statistics.first_row(clients(s, d), "client_id"),
    "top_scores": top_scores,
    "preview_rows": lambda s, d: statistics.page(students(s, d), "row_key", 10),
}


# --- sources, projections and filters --------------------------------------

def csv_roundtrip(spark, base_dir):
    table = students(spark, base_dir)
    path = scratch_path(spark, "students-csv")
    write_csv(table, path)
    return read_csv(spark, path, table.schema)


def csv_texts(spark, base_dir):
    """Documents with line breaks, and padded, empty and null texts among them."""
    key = F.col("doc_id")
    table = read_table(spark, base_dir, "documents").select(
        "doc_id", F.when(key % 11 == 0, None).when(key % 11 == 1, "").when(key % 11 == 2, F.concat(F.lit("  "), "text", F.lit("\t ")))
        .otherwise(F.col("text")).alias("text"))
    path = scratch_path(spark, "texts-csv")
    write_csv(table, path)
    return read_csv(spark, path, table.schema)


def parse_records(spark, base_dir):
    return parsed_json(read_table(spark, base_dir, "events").select("event_id", "props"), "props", "k int")


def typed_payloads(spark, base_dir):
    payloads = read_table(spark, base_dir, "events").select(
        "event_id", F.from_json("props", "map<string, string>").alias("payload")
    )
    return typed_payload(payloads, "payload", {"k": "double", "absent": "string"})


def events_as_json(spark, base_dir):
    kind = F.col("event_type")
    rows = read_table(spark, base_dir, "events").select(
        "event_id", "ts", F.to_date("ts").alias("day"),
        F.when(kind == "error", float("nan")).otherwise(F.col("value")).alias("value"),
        kind.cast("binary").alias("raw"), F.array(kind, F.lit(None)).alias("parts"),
        F.create_map("user_id", "event_id").alias("by_user"),
    )
    return json_rows(rows, "event_id")


def name_map(spark, base_dir):
    """Half the records under each spelling, the other left empty or null."""
    table = clients(spark, base_dir).select("client_id", *CATEGORIES, *FLAGS)
    asked = F.col("client_id") % 2 == 0
    both = []
    for request, (stored, column) in NAMES.items():
        if stored == request:
            both.append(F.col(column).alias(request))
        else:
            blank = F.when(F.col("client_id") % 3 == 0, "")
            both.append(F.when(asked, F.col(column)).otherwise(blank).alias(request))
            both.append(F.when(~asked, F.col(column)).alias(stored))
    return to_table_names(table.select("client_id", *both), ("client_id",))


def nan_to_null(spark, base_dir):
    table = students(spark, base_dir).select("row_key", F.coalesce("cgpa", F.lit(float("nan"))).alias("cgpa"))
    return columns.nan_as_null(table)


def columns_by_prefix(spark, base_dir):
    wide = encode.one_hot(students(spark, base_dir), ["sleep_duration"])
    return columns.with_prefix(wide, ["row_key", "academic_pressure"], "sleep_duration_")


def value_map(spark, base_dir):
    flag = F.when(F.col("suicidal_thoughts") == "Yes", 1).otherwise(0)
    return students(spark, base_dir).select(
        "row_key", mapped(flag, {1: "Yes", 0: "No"}).alias("thoughts"),
        mapped(F.col("depression"), {1: "Depression"}).alias("mapped"),
    )


def validate_records(spark, base_dir):
    checked = columns.validated(raw_records(spark, base_dir))
    return checked.withColumn("reject_reason", F.concat_ws("; ", "reject_reason"))


COLUMNS: dict[str, Query] = {
    "scan_parquet": lambda s, d: read_table(s, d, "customer"),
    "csv_roundtrip": csv_roundtrip,
    "csv_texts": csv_texts,
    "parse_records": parse_records,
    "typed_payloads": typed_payloads,
    "json_rows": events_as_json,
    "label_cast": lambda s, d: columns.with_label(clients(s, d), "adesao"),
    "drop_columns": lambda s, d: columns.without(students(s, d), ["id", "city", "profession"]),
    "select_existing": lambda s, d: columns.select_existing(
        clients(s, d), ["client_id", *statistics.PAGE_COLUMNS, "absent"]
    ),
    "underscore_alias": lambda s, d: with_underscore_names(to_stored_names(clients(s, d))),
    "name_map": name_map,
    "equality_filter": lambda s, d: columns.where_equal(clients(s, d), "adesao", 1),
    "membership_filter": lambda s, d: columns.where_in(students(s, d), "dietary_habits", DIET_ORDER),
    "drop_null_target": lambda s, d: columns.drop_null(clients(s, d), "adesao"),
    "nan_to_null": nan_to_null,
    "columns_by_prefix": columns_by_prefix,
    "features_without_target": lambda s, d: columns.features_and_target(students(s, d), "depression")[0],
    "columns_by_type": lambda s, d: students(s, d).select(*columns.numeric_columns(students(s, d))),
    "value_map": value_map,
    "prediction_text": lambda s, d: scored_students(s, d).select(
        "row_key", prediction_text(F.col("p")).alias("label_text")
    ),
    "validate_records": validate_records,
}


# --- profiles --------------------------------------------------------------

def describe(spark, base_dir):
    table = students(spark, base_dir).select("id", *SURVEY_NUMBERS)
    return rounded(profile.describe(table), 6, "mean", "std", "q25", "q50", "q75")


def corr_matrix(spark, base_dir):
    wide = encode.one_hot(survey(spark, base_dir), ["gender"])
    return rounded(profile.correlation_matrix(wide), 6, "r")


def column_sums(spark, base_dir):
    wide = encode.one_hot(survey(spark, base_dir).select("gender"), ["gender"])
    return profile.column_sums(wide, wide.columns)


def box_satisfaction_by_age(spark, base_dir):
    table = encode.age_group(students(spark, base_dir))
    return rounded(distribution.box_stats(table, "age_group", "study_satisfaction"), 6, "q1", "median", "q3")


def box_cgpa_by_label(spark, base_dir):
    return rounded(distribution.box_stats(students(spark, base_dir), "depression", "cgpa"), 6, "q1", "median", "q3")


def box_price_by_flag(spark, base_dir):
    charge = F.col("l_extendedprice") * F.col("l_discount") * F.col("l_tax")
    table = read_table(spark, base_dir, "lineitem").select("l_returnflag", charge.alias("x"))
    return rounded(distribution.box_stats(table, "l_returnflag", "x"), 6, "q1", "median", "q3")


def price_quantiles(spark, base_dir):
    table = read_table(spark, base_dir, "lineitem")
    wanted = {"p01": 0.01, "p50": 0.5, "p99": 0.99}
    return rounded(quantiles.exact_quantiles(table, ["l_extendedprice", "l_quantity"], wanted), 6, *wanted)


PROFILES: dict[str, Query] = {
    "value_counts": lambda s, d: profile.value_counts(survey(s, d)),
    "target_balance": lambda s, d: statistics.count_by(students(s, d), "depression"),
    "describe": describe,
    "column_info": lambda s, d: profile.column_info(students(s, d)),
    "missing_counts": lambda s, d: profile.missing_counts(clients(s, d)),
    "duplicate_count": lambda s, d: profile.duplicate_count(survey(s, d)),
    "drop_duplicates": lambda s, d: profile.drop_duplicates(survey(s, d)),
    "kind_census": lambda s, d: profile.kind_census(survey(s, d)),
    "modes": lambda s, d: profile.modes(survey(s, d)),
    "column_sums": column_sums,
    "corr_matrix": corr_matrix,
    "count_table": lambda s, d: profile.count_table(students(s, d), "sleep_duration", "suicidal_thoughts"),
    "cross_table": lambda s, d: profile.cross_table(students(s, d), "sleep_duration", "depression"),
    "box_satisfaction_by_age": box_satisfaction_by_age,
    "box_cgpa_by_label": box_cgpa_by_label,
    "box_price_by_flag": box_price_by_flag,
    "histogram": lambda s, d: rounded(distribution.histogram(students(s, d), "cgpa"), 9, "low", "high"),
    "density": lambda s, d: rounded(distribution.density(students(s, d), "cgpa"), 6, "x", "density"),
    "medians": lambda s, d: rounded(quantiles.medians(students(s, d), SURVEY_NUMBERS), 6, "median"),
    "price_quantiles": price_quantiles,
}


# --- features and splits ---------------------------------------------------

def string_index(spark, base_dir):
    indexed = encode.frequency_index(clients(spark, base_dir), CATEGORIES)
    return indexed.select("client_id", *[f"{c}_idx" for c in CATEGORIES])


def frequency_codes(spark, base_dir):
    table = read_table(spark, base_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 50 != 0, F.col("l_partkey").cast("string")).alias("part")
    )
    return encode.frequency_coded(table, "part", "part_code")


def assemble(spark, base_dir):
    indexed = encode.frequency_index(clients(spark, base_dir), CATEGORIES)
    vectors = encode.assembled_array(indexed, [*[f"{c}_idx" for c in CATEGORIES], *FLAGS])
    return vectors.select("client_id", as_text("features"))


def as_text(column: str):
    numbers = F.transform(F.col(column), lambda v: v.cast("int").cast("string"))
    return F.array_join(numbers, ",").alias(column)


def label_encode(spark, base_dir):
    kept = columns.where_in(students(spark, base_dir), "dietary_habits", DIET_ORDER)
    coded = encode.label_encoded(encode.age_group(kept), "age_group", "age_group_encoded")
    return coded.select("row_key", "age_group", "age_group_encoded")


def ordinal_encode(spark, base_dir):
    kept = columns.where_in(students(spark, base_dir), "dietary_habits", DIET_ORDER)
    coded = encode.ordinal_encoded(kept, "dietary_habits", DIET_ORDER, "dietary_encoded")
    return coded.select("row_key", "dietary_habits", "dietary_encoded")


def one_hot_drop_first(spark, base_dir):
    table = clients(spark, base_dir).select("client_id", "faixa_etaria", "gp_renda")
    return encode.one_hot(table, ["faixa_etaria", "gp_renda"], drop_first=True)


def one_hot_vector(spark, base_dir):
    table = clients(spark, base_dir).select("client_id", "faixa_etaria")
    vectors = encode.one_hot_vector(table, ["faixa_etaria"])
    return vectors.withColumn("faixa_etaria_onehot", vector_to_array("faixa_etaria_onehot")).select(
        "client_id", as_text("faixa_etaria_onehot")
    )


def align_features(spark, base_dir):
    return encode.aligned(clients(spark, base_dir), ["usa_pix", "absent", "renda"])


def one_hot_decode(spark, base_dir):
    levels = encode.fit_levels(students(spark, base_dir), ["sleep_duration"])
    wide = encode.one_hot(students(spark, base_dir), ["sleep_duration"], levels)
    names = [level.replace("'", "") for level in levels["sleep_duration"]]
    indicators = [f"sleep_duration_{level}" for level in levels["sleep_duration"]]
    return wide.select("row_key", decoded_one_hot(indicators, names).alias("sleep_duration"))


def median_fill(spark, base_dir):
    table = clients(spark, base_dir).select("client_id", "renda")
    return encode.median_filled(table, encode.fit_medians(table, ["renda"]))


def prepare_training(spark, base_dir):
    table = clients(spark, base_dir).select("client_id", "renda", "adesao", "faixa_etaria", "gp_renda")
    return encode.TablePreparation.fit(table, "adesao", keys=["client_id"]).transform(table)


def fitted_survey(spark, base_dir):
    """Age codes, one-hot levels and feature order of the survey rows."""
    rows = encode.age_group(columns.where_in(students(spark, base_dir), "dietary_habits", DIET_ORDER))
    codes = {r["level"]: r["code"] for r in encode.level_codes(rows, "age_group").collect()}
    levels = encode.fit_levels(rows, ["gender", "suicidal_thoughts", "sleep_duration"])
    sleep = [f"sleep_duration_{level}" for level in levels["sleep_duration"]]
    return codes, levels, [*LISTED_FEATURES, *sleep]


def prepare_new_rows(spark, base_dir):
    codes, levels, features = fitted_survey(spark, base_dir)
    rows = encode.age_group(columns.where_in(students(spark, base_dir), "dietary_habits", DIET_ORDER))
    return encode.prepared_survey(rows, features, codes, levels, keep=("row_key",))


def feature_list(spark, base_dir):
    _, _, features = fitted_survey(spark, base_dir)
    path = scratch_path(spark, "features")
    encode.save_feature_list(spark, features, path)
    return spark.read.parquet(path)


def export_features(spark, base_dir):
    path = scratch_path(spark, "features-csv")
    chosen = training.export_features(spark, clients(spark, base_dir), path)
    return read_csv(spark, path, chosen.schema)


def split_hash(spark, base_dir):
    return students(spark, base_dir).select("row_key", split.in_train(F.col("row_key")).alias("in_train"))


def split_stratified(spark, base_dir):
    table = students(spark, base_dir).select("row_key", "depression")
    return split.stratified_split(table, "depression", "row_key")


def split_random(spark, base_dir):
    """Whether each row is in one part only, and the parts have their sizes."""
    train, test = split.random_split(clients(spark, base_dir).select("client_id"))
    both = train.withColumn("part", F.lit("train")).union(test.withColumn("part", F.lit("test")))
    per_key = both.groupBy("client_id").agg(F.count(F.lit(1)).alias("parts"), F.count_if(F.col("part") == "train").alias("train"))
    share = F.sum("train") / F.count(F.lit(1))
    # four standard deviations round the wanted share
    near = F.abs(share - 0.8) <= 4 * F.sqrt(F.lit(0.16) / F.count(F.lit(1)))
    return per_key.agg(F.count(F.lit(1)).alias("n_rows"), F.max("parts").alias("most_parts"), near.alias("share_is_near"))


def many_levels(spark, base_dir):
    """One-hot of a text with a level per row, as a sparse vector over the whole table."""
    table = read_table(spark, base_dir, "customer").select("c_custkey", "c_name")
    vectors = one_hot_levels(table, "c_name")
    # the dense form would hold a number per level and row
    entries = vectors.select("c_custkey", F.from_json(F.to_json(F.struct(F.col("c_name_onehot").alias("v"))),
                                                      "v struct<size: int, indices: array<int>, values: array<double>>").alias("j"))
    ones = F.aggregate("j.v.values", F.lit(0.0), lambda a, x: a + x)
    return entries.select("c_custkey", ones.cast("int").alias("indicators"), F.col("j.v.size").alias("n_features"),
                          F.get("j.v.indices", F.lit(0)).alias("position"))


def many_levels_whole(spark, base_dir):
    """Codes of a text with a level per row, over the whole table and without a column per level."""
    table = read_table(spark, base_dir, "customer").select("c_custkey", "c_name")
    return encode.frequency_coded(table, "c_name", "name_code").select("c_custkey", "c_name", "name_code")


FEATURES: dict[str, Query] = {
    "string_index": string_index,
    "frequency_codes": frequency_codes,
    "assemble": assemble,
    "age_bins": lambda s, d: encode.age_group(students(s, d)).select("row_key", "age", "age_group"),
    "label_encode": label_encode,
    "ordinal_encode": ordinal_encode,
    "one_hot": lambda s, d: encode.one_hot(students(s, d), ["sleep_duration", "gender"]),
    "one_hot_drop_first": one_hot_drop_first,
    "one_hot_text": lambda s, d: encode.one_hot_text(
        clients(s, d).select("client_id", "renda", "faixa_etaria", "gp_renda")
    ),
    "one_hot_vector": one_hot_vector,
    "align_features": align_features,
    "one_hot_decode": one_hot_decode,
    "median_fill": median_fill,
    "prepare_training": prepare_training,
    "survey_features": lambda s, d: encode.survey_features(students(s, d)),
    "prepare_new_rows": prepare_new_rows,
    "feature_list": feature_list,
    "export_features": export_features,
    "split_hash": split_hash,
    "split_stratified": split_stratified,
    "split_random": split_random,
    "many_levels": many_levels,
    "many_levels_whole": many_levels_whole,
}


# --- metrics and models ----------------------------------------------------

METRICS: dict[str, Query] = {
    "auc": lambda s, d: rounded(metrics.area_under_roc(scored_students(s, d), "y", "score"), 9, "auc"),
    "accuracy": lambda s, d: rounded(metrics.accuracy(scored_students(s, d), "y", "p"), 9, "accuracy"),
    "weighted_f1": lambda s, d: rounded(metrics.weighted_f1(scored_students(s, d), "y", "p"), 9, "f1"),
    "class_report": lambda s, d: rounded(
        metrics.class_report(scored_students(s, d), "y", "p"), 9, "precision", "recall", "f1"
    ),
    "confusion_matrix": lambda s, d: metrics.confusion_matrix(scored_students(s, d), "y", "p"),
    "confusion_three": lambda s, d: metrics.confusion_matrix(
        read_table(s, d, "lineitem").select((F.col("l_linenumber") % 3).alias("y"), (F.col("l_suppkey") % 4).alias("p")), "y", "p"),
    "confusion_labels": lambda s, d: metrics.confusion_matrix(read_table(s, d, "labels"), "quality", "toxic"),
}

# Models are trained once per table and session and then loaded from the shared
# folder, as scoring jobs do; only their paths are kept.
_trained: dict[tuple[str, str, str], str] = {}


def forest_model(spark: SparkSession, base_dir: str) -> str:
    key = (spark.sparkContext.applicationId, base_dir, "forest")
    if key not in _trained:
        path = scratch_path(spark, "forest")
        training.save_training(spark, training.train_forest(clients(spark, base_dir)), f"{path}/model", f"{path}/metadata")
        _trained[key] = path
    return _trained[key]


def light_model(spark: SparkSession, base_dir: str) -> str:
    key = (spark.sparkContext.applicationId, base_dir, "light")
    if key not in _trained:
        scorer, _ = training.train_light_forest(clients(spark, base_dir).select("client_id", "adesao", *LIGHT_COLUMNS))
        path = scratch_path(spark, "light-forest")
        scorer.save(spark, path)
        _trained[key] = path
    return _trained[key]


def page_index(spark: SparkSession, base_dir: str) -> PageIndex:
    key = (spark.sparkContext.applicationId, base_dir, "pages")
    if key not in _trained:
        path = scratch_path(spark, "pages")
        PageIndex.build(students(spark, base_dir).select("id", "row_key", "age"), "id", path, rows_per_zone=10_000)
        _trained[key] = path
    return PageIndex(spark, _trained[key], "id")


def deep_page_indexed(spark, base_dir):
    """The same page as ``deep_page``, read by its place from the written zones."""
    index = page_index(spark, base_dir)
    return index.page(40, index.total() // 2)


def csv_split(spark, base_dir):
    """Documents with line breaks in quoted texts, read back record by record from blocks."""
    key = F.col("doc_id")
    table = read_table(spark, base_dir, "documents").select(
        "doc_id", F.when(key % 11 == 0, None).when(key % 11 == 1, "").when(key % 11 == 2, F.concat(F.lit("  "), "text", F.lit("\t ")))
        .otherwise(F.col("text")).alias("text"))
    path = scratch_path(spark, "texts-csv")
    write_csv(table, path)
    return read_split_csv(spark, path, table.schema, CSV_FORM)


def indexed_levels(spark, base_dir):
    """The clients' category codes by the saved and reloaded index that joins."""
    path = scratch_path(spark, "levels")
    LevelIndex.fit(clients(spark, base_dir), CATEGORIES, path)
    coded = LevelIndex.load(spark, path).transform(clients(spark, base_dir))
    return coded.select("client_id", *[f"{c}_idx" for c in CATEGORIES])


def required_columns(spark, base_dir):
    """The table once its model inputs are known to be there, and the complaint if one isn't."""
    table = columns.require(clients(spark, base_dir), ["client_id", *CATEGORIES, *FLAGS])
    try:
        columns.require(table, ["client_id", "absent"])
        complaint = None
    except ValueError as error:
        complaint = "absent" in str(error)
    return table.select("client_id", *CATEGORIES, F.lit(complaint).alias("complains"))


def forest_scorer(spark: SparkSession, base_dir: str) -> FlatScorer:
    return FlatScorer.load(spark, f"{forest_model(spark, base_dir)}/model")


def checked_metrics(held_out: DataFrame) -> DataFrame:
    """Per metric: the rows it is taken over, whether it lies in [0, 1], and whether
    Spark's own evaluators find the same."""
    rows = held_out.select("label", F.col("prediction").cast("double").alias("prediction"), "score").persist()
    ours = metrics.evaluate(rows, "label", "prediction", "score")
    theirs = {n: MulticlassClassificationEvaluator(metricName=n).evaluate(rows) for n in ("accuracy", "f1")}
    theirs["auc"] = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(rows)
    checks = [(n, 0 <= v <= 1, abs(v - theirs[n]) < 1e-6) for n, v in ours.items()]
    table = rows.sparkSession.createDataFrame(checks, "metric string, in_range boolean, agrees boolean")
    return table.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n_rows"))))


def labelled_hold_out(spark: SparkSession, base_dir: str) -> DataFrame:
    rows = columns.drop_null(clients(spark, base_dir), "adesao")
    return split.hash_split(rows, "client_id")[1]


def forest_metrics(spark, base_dir):
    rows = scored(load_model(f"{forest_model(spark, base_dir)}/model"), labelled_hold_out(spark, base_dir), ["adesao"], scoring_tasks(spark))
    return checked_metrics(columns.with_label(rows, "adesao"))


def light_forest_metrics(spark, base_dir):
    rows = labelled_hold_out(spark, base_dir).select("client_id", "adesao", *LIGHT_COLUMNS)
    scorer = LightScorer.load(spark, light_model(spark, base_dir))
    return checked_metrics(columns.with_label(scorer.score_table(rows, ["adesao"], scoring_tasks(spark)), "adesao"))


def scoring_tasks(spark: SparkSession) -> int:
    """Tables that come from a few joins are scored by all cores."""
    return spark.sparkContext.defaultParallelism


def score_checks(rows: DataFrame) -> DataFrame:
    """Whether scores are probabilities, and class and text follow from them."""
    total = F.aggregate("probability", F.lit(0.0), lambda a, p: a + p)
    return rows.withColumns({
        "sums_to_one": F.abs(total - 1) < 1e-9,
        "class_follows": F.col("prediction") == (F.col("score") > 0.5).cast("int"),
        "text_follows": F.col("label_text") == prediction_text(F.col("prediction")),
    }).drop("probability", "prediction", "score", "label_text")


def forest_scores(spark, base_dir):
    scorer = forest_scorer(spark, base_dir)
    return score_checks(scorer.score_table(clients(spark, base_dir), ["client_id", "adesao"], scoring_tasks(spark)))


def class_probabilities(spark, base_dir):
    rows = forest_scorer(spark, base_dir).score_table(clients(spark, base_dir), ["client_id"], scoring_tasks(spark))
    exploded = rows.select("client_id", F.posexplode("probability").alias("class", "p"))
    return exploded.select("client_id", "class", F.col("p").between(0, 1).alias("in_range"))


def survey_training(spark: SparkSession, base_dir: str):
    """The survey model end to end: listed features, stratified split, boosted trees."""
    codes, levels, features = fitted_survey(spark, base_dir)
    rows = encode.age_group(columns.where_in(students(spark, base_dir), "dietary_habits", DIET_ORDER))
    prepared = encode.prepared_survey(rows, features, codes, levels, keep=("row_key", "depression"))
    return features, training.train_boosted(prepared, features, "depression", "row_key", stratified=True)


def boosted_metrics(spark, base_dir):
    _, trained = survey_training(spark, base_dir)
    return checked_metrics(trained.held_out)


def survey_report(spark, base_dir):
    """Support per class and in all, from the report and from the confusion matrix."""
    _, trained = survey_training(spark, base_dir)
    counts = metrics.confusion_counts(trained.held_out, "label", "prediction")
    by_matrix = counts.groupBy(metrics.class_name(F.col("actual")).alias("class")).agg(F.sum("count").alias("in_matrix"))
    report = metrics.class_report(trained.held_out, "label", "prediction").filter("class in ('0', '1')")
    return report.join(by_matrix, "class").select("class", "support", "in_matrix", F.col("f1").between(0, 1).alias("f1_in_range"))


def survey_importance(spark, base_dir):
    """Permutation importance of the survey model: every listed feature, once."""
    features, trained = survey_training(spark, base_dir)
    *_, boosted = trained.model.stages
    found = permutation_importance(boosted, trained.held_out_features, features, "row_key")
    return found.select("feature", F.col("importance").between(-1, 1).alias("in_range"), (F.col("deviation") >= 0).alias("spread"))


def survey_scores(spark, base_dir):
    """New survey rows scored by the saved and reloaded survey model."""
    features, trained = survey_training(spark, base_dir)
    path = scratch_path(spark, "survey-model")
    save_model(trained.model, path)
    fresh = encode.median_filled(prepare_new_rows(spark, base_dir), trained.medians)
    model = load_model(path)
    return score_checks(scored(model, fresh, ["row_key"]))


#: Inputs with few values each, some of them missing, for trees that SQL can follow.
STEPS = ["income_step", "usa_pix", "usa_ebanking", "emprestimo", "financiamento", "cartao_de_credito", "atrasa_pag"]


def stepped_clients(spark: SparkSession, base_dir: str) -> DataFrame:
    return columns.drop_null(clients(spark, base_dir), "adesao").withColumn("income_step", F.floor(F.col("renda") / 1000))


def one_tree(spark: SparkSession, base_dir: str) -> tuple[boosting.Boosted, DataFrame]:
    """A penalised tree of depth two at full rate, and its rows."""
    rows = stepped_clients(spark, base_dir)
    settings = boosting.Boosting(rate=1.0, rounds=1, max_depth=2, max_leaves=4)
    return boosting.fit(rows, STEPS, "adesao", settings=settings), rows


def boosted_splits(spark, base_dir):
    """Every first split of the survey rows at the production settings, with its gain for the
    missing on each side."""
    found = boosting.root_splits(students(spark, base_dir), SURVEY_NUMBERS[:4], "depression")
    return rounded(found, 6, "threshold", "gain")


def client_splits(spark, base_dir):
    return rounded(boosting.root_splits(stepped_clients(spark, base_dir), STEPS, "adesao"), 6, "threshold", "gain")


def boosted_leaves(spark, base_dir):
    """Value and rows of each leaf of the one tree."""
    model, rows = one_tree(spark, base_dir)
    values = spark.createDataFrame([(r["tree"], r["node"], r["path"], r["value"]) for r in model.leaves()], "tree int, node int, path string, value double")
    return rounded(leaf_counts(model.scorer(), rows).join(F.broadcast(values), ["tree", "node"]).select("path", "rows", "value"), 9, "value")


def boosted_confusion(spark, base_dir):
    """Confusion cells of the one tree's predictions, exported and read again."""
    model, rows = one_tree(spark, base_dir)
    path = scratch_path(spark, "one-tree")
    model.save(spark, f"{path}/model")
    boosting.Boosted.load(spark, f"{path}/model").scorer().scored(rows, ["client_id", "adesao"]).write.parquet(f"{path}/scores")
    return metrics.confusion_matrix(spark.read.parquet(f"{path}/scores"), "adesao", "prediction", classes=[0, 1])


def survey_run(spark: SparkSession, base_dir: str) -> str:
    """The survey job at its production settings, run once per table and session."""
    key = (spark.sparkContext.applicationId, base_dir, "survey")
    if key not in _trained:
        codes, levels, features = fitted_survey(spark, base_dir)
        rows = encode.age_group(columns.where_in(students(spark, base_dir), "dietary_habits", DIET_ORDER))
        prepared = encode.prepared_survey(rows, features, codes, levels, keep=("row_key", "depression"))
        path = scratch_path(spark, "survey")
        training.survey_job(spark, prepared, features, "depression", "row_key", path)
        _trained[key] = path
    return _trained[key]


def survey_job(spark, base_dir):
    """What the one run left: confusion cells, report and importance of its written scores."""
    path = survey_run(spark, base_dir)
    scores = spark.read.parquet(f"{path}/scores")
    cells = metrics.confusion_counts(scores, "label", "prediction").select(
        F.lit("cell").alias("part"), F.concat_ws("/", metrics.class_name(F.col("actual")), metrics.class_name(F.col("predicted"))).alias("name"),
        F.col("count").cast("double").alias("value"))
    report = metrics.class_report(scores, "label", "prediction").select(F.lit("f1").alias("part"), F.col("class").alias("name"), F.col("f1").alias("value"))
    importance = spark.read.parquet(f"{path}/importance").select(F.lit("importance").alias("part"), F.col("feature").alias("name"), F.col("importance").alias("value"))
    return cells.unionByName(report).unionByName(importance)


def judged_records(scores: DataFrame, rejects: DataFrame) -> DataFrame:
    """A row per record: its checks if it was scored, its reasons if it was not."""
    good = score_checks(scores.drop("unmatched")).withColumns({"accepted": F.lit(True), "reasons": F.lit(None).cast("string")})
    ok = F.col("sums_to_one") & F.col("class_follows") & F.col("text_follows")
    bad = rejects.select(F.col("client_id").cast("long"), F.lit(False).alias("accepted"),
                         F.concat_ws("; ", "reject_reason").alias("reasons"), F.lit(None).cast("boolean").alias("score_ok"))
    return good.select(F.col("client_id").cast("long"), "accepted", "reasons", ok.alias("score_ok")).unionByName(bad)


def score_raw_records(spark, base_dir):
    scores, rejects = score_records(forest_scorer(spark, base_dir), raw_records(spark, base_dir), ["client_id"], scoring_tasks(spark))
    return judged_records(scores, rejects)


def same_scores(first: DataFrame, second: DataFrame) -> DataFrame:
    other = second.select("client_id", F.col("score").alias("again"))
    return first.join(other, "client_id").select("client_id", (F.col("score") == F.col("again")).alias("same"))


def score_payloads(spark, base_dir):
    """Untyped JSON objects typed by the feature list score as the table does."""
    scorer = LightScorer.load(spark, light_model(spark, base_dir))
    table = clients(spark, base_dir).select("client_id", *LIGHT_COLUMNS)
    kinds = {c: kind for c, kind in table.dtypes if c in LIGHT_COLUMNS}
    payloads = table.select(
        "client_id", F.from_json(F.to_json(F.struct(*LIGHT_COLUMNS)), "map<string, string>").alias("payload")
    )
    tasks = scoring_tasks(spark)
    return same_scores(scorer.score_table(typed_payload(payloads, "payload", kinds), ["client_id"], tasks),
                       scorer.score_table(table, ["client_id"], tasks))


def chosen_scorer(spark, base_dir):
    """The chosen scorer is the lighter model: records score as its table does."""
    light, forest = light_model(spark, base_dir), forest_model(spark, base_dir)
    scorer = choose_scorer(spark, light_path=light, pipeline_path=f"{forest}/model")
    table, tasks = clients(spark, base_dir), scoring_tasks(spark)
    return same_scores(scorer.score(to_request_names(table), ["client_id"], tasks),
                       LightScorer.load(spark, light).score_table(table.select("client_id", *LIGHT_COLUMNS), ["client_id"], tasks))


def model_save_load(spark, base_dir):
    """Rows on which a saved and reloaded model agrees with itself."""
    first = load_model(f"{forest_model(spark, base_dir)}/model")
    copy = scratch_path(spark, "forest-copy")
    save_model(first, copy)
    table, tasks = clients(spark, base_dir), scoring_tasks(spark)
    before = scored(first, table, ["client_id"], tasks).select("client_id", F.col("score").alias("before"))
    after = scored(load_model(copy), table, ["client_id"], tasks).select("client_id", F.col("score").alias("after"))
    return before.join(after, "client_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("before") == F.col("after")).alias("n_same")
    )


def given_values(spark: SparkSession, base_dir: str) -> DataFrame:
    """feature and n_given: rows of the client table in which a model input is given."""
    table = clients(spark, base_dir)
    counts = table.agg(*[F.count(c).alias(c) for c in (*CATEGORIES, *FLAGS)])
    return counts.unpivot([], [*CATEGORIES, *FLAGS], "feature", "n_given")


def model_metadata(spark, base_dir):
    """The saved metadata's columns with their kind, and how often clients have them."""
    saved = read_metadata(spark, f"{forest_model(spark, base_dir)}/metadata")
    kinds = F.array(F.struct(F.lit("category").alias("kind"), F.col("categorical_cols").alias("names")),
                    F.struct(F.lit("number").alias("kind"), F.col("numeric_cols").alias("names")))
    listed = saved.select(F.inline(kinds), "model_type", "num_trees", "max_depth").select(
        "kind", F.explode("names").alias("feature"), "model_type", "num_trees", "max_depth")
    return listed.join(given_values(spark, base_dir), "feature")


def pipeline_features(spark, base_dir):
    """The forest's inputs in vector order, and how often clients have them."""
    names = feature_names(load_model(f"{forest_model(spark, base_dir)}/model"))
    listed = spark.createDataFrame(list(enumerate(names)), "pos int, name string")
    source = F.regexp_replace("name", "_idx$", "")
    return listed.withColumn("feature", source).join(given_values(spark, base_dir), "feature").select("pos", F.col("name").alias("feature"), "n_given")


def forest_importance(spark, base_dir):
    """Every input's share in range, and all shares together 100."""
    found = global_importance(spark, load_model(f"{forest_model(spark, base_dir)}/model"))
    total = found.agg(F.sum("importance").alias("total"))
    near = found.crossJoin(F.broadcast(total)).withColumn("feature", F.regexp_replace("feature", "_idx$", ""))
    return near.join(given_values(spark, base_dir), "feature").select(
        "feature", F.col("importance").between(0, 100).alias("in_range"), (F.abs(F.col("total") - 100) < 0.01).alias("sums_to_100"), "n_given")


def forest_permutation(spark, base_dir):
    """Importance on the hold-out rows, fifteen shuffles per feature."""
    scorer = forest_scorer(spark, base_dir)
    test = columns.with_label(labelled_hold_out(spark, base_dir), "adesao")
    found = permutation_importance(scorer.trees, scorer.indexer.transform(test), scorer.trees.features, "client_id")
    rows = test.agg(F.count(F.lit(1)).alias("n_rows"))
    return found.crossJoin(F.broadcast(rows)).select(
        F.regexp_replace("feature", "_idx$", "").alias("feature"), F.col("importance").between(-1, 1).alias("in_range"),
        (F.col("deviation") >= 0).alias("spread"), "n_rows")


def export_transformed(spark, base_dir):
    """The transformed table's index columns, exported and read again."""
    path = scratch_path(spark, "features-csv")
    wanted = ["client_id", *[f"{c}_idx" for c in CATEGORIES]]
    model = f"{forest_model(spark, base_dir)}/model"
    chosen = training.export_features(spark, clients(spark, base_dir), path, model, columns=wanted)
    return read_csv(spark, path, chosen.schema)


def stream_scores(spark, base_dir):
    """Clients written as JSON files, then validated and scored as a stream."""
    work = scratch_path(spark, "stream")
    raw_records(spark, base_dir).write.json(f"{work}/in")
    query = score_stream(
        read_records(spark, f"{work}/in"), forest_scorer(spark, base_dir),
        f"{work}/scores", f"{work}/rejects", f"{work}/checkpoint",
    )
    query.awaitTermination()
    scores, rejects = spark.read.parquet(f"{work}/scores"), spark.read.parquet(f"{work}/rejects")
    return judged_records(scores.drop("batch"), rejects)


MODELS: dict[str, Query] = {
    "deep_page_indexed": deep_page_indexed,
    "csv_split": csv_split,
    "indexed_levels": indexed_levels,
    "required_columns": required_columns,
    "forest_metrics": forest_metrics,
    "light_forest_metrics": light_forest_metrics,
    "survey_report": survey_report,
    "survey_importance": survey_importance,
    "survey_scores": survey_scores,
    "boosted_metrics": boosted_metrics,
    "boosted_splits": boosted_splits,
    "client_splits": client_splits,
    "boosted_leaves": boosted_leaves,
    "boosted_confusion": boosted_confusion,
    "survey_job": survey_job,
    "forest_scores": forest_scores,
    "class_probabilities": class_probabilities,
    "score_records": score_raw_records,
    "score_payloads": score_payloads,
    "choose_scorer": chosen_scorer,
    "model_save_load": model_save_load,
    "model_metadata": model_metadata,
    "pipeline_features": pipeline_features,
    "global_importance": forest_importance,
    "permutation_importance": forest_permutation,
    "export_transformed": export_transformed,
    "stream_scores": stream_scores,
}


def queries() -> dict[str, Query]:
    return {**STATISTICS, **COLUMNS, **PROFILES, **FEATURES, **METRICS, **MODELS}
