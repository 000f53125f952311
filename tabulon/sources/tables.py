"""Parquet and CSV tables, and the derived ``clients`` and ``students`` views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


# The same on both sides; a text that is the null mark itself would read as null.
CSV_FORM = {
    "escape": '"', "nullValue": "\\N", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header, as :func:`write_csv` writes it. Without a schema the
    types are inferred, which costs a second pass over the files; give one for
    anything large. Quoted line breaks are kept, so a file is read by one task."""
    reader = spark.read.options(**CSV_FORM).options(header=True, multiLine=True, emptyValue="")
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """CSV with a header, one file per task; nothing passes through the driver.

    Null and empty text differ, padding and line breaks stay. Files are cut after
    ``rows_per_file`` rows, as a file with line breaks in its texts can't be split.
    """
    df.write.mode("overwrite").options(**CSV_FORM).options(
        header=True, emptyValue='""', maxRecordsPerFile=rows_per_file).csv(path)


def clients(spark: SparkSession, base_dir: str) -> DataFrame:
    """One row per bank client: ten categories, ten 0/1 flags, income, label."""
    orders = read_table(spark, base_dir, "orders")
    customer = read_table(spark, base_dir, "customer")
    nation = read_table(spark, base_dir, "nation").select("n_nationkey", "n_name")

    def ever(condition):
        return F.max(F.when(condition, 1).otherwise(0))

    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    activity = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum("o_totalprice").alias("spend"),
        ever(priority == "1-URGENT").alias("f_urgent"),
        ever(priority == "2-HIGH").alias("f_high"),
        ever(priority == "3-MEDIUM").alias("f_medium"),
        ever(priority == "4-NOT SPECIFIED").alias("f_unset"),
        ever(priority == "5-LOW").alias("f_low"),
        ever(status == "F").alias("f_done"),
        ever(status == "O").alias("f_open"),
        ever(status == "P").alias("f_part"),
        ever(F.col("o_totalprice") > 450000).alias("f_large"),
    )
    key, balance, spend = F.col("c_custkey"), F.col("c_acctbal"), F.col("spend")

    def flag(name):
        return F.coalesce(F.col(name), F.lit(0))

    def pick(divisor, *values):
        """Value chosen by key modulo ``divisor``; the last one takes the rest."""
        expr = F.when(key % divisor == 0, values[0])
        for remainder, value in enumerate(values[1:-1], start=1):
            expr = expr.when(key % divisor == remainder, value)
        return expr.otherwise(values[-1])

    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(activity, key == F.col("o_custkey"), "left")
        .select(
            key.alias("client_id"),
            F.when(key % 53 != 0, F.col("n_name")).alias("estado"),
            pick(6, "18-24", "25-34", "35-44", "45-54", "55-64", "65+").alias("faixa_etaria"),
            pick(2, "F", "M").alias("sexo"),
            F.col("c_mktsegment").alias("ocupacao"),
            pick(4, "Fundamental", "Medio", "Superior", "Pos").alias("escolaridade"),
            F.when(key % 41 != 0, balance).alias("renda"),
            F.when(balance < 3000, "Baixa").when(balance < 7000, "Media").otherwise("Alta").alias("gp_renda"),
            F.when(spend < 1500000, "Baixo").when(spend < 3000000, "Medio")
            .when(spend.isNotNull(), "Alto").alias("gp_gasto_mensal"),
            pick(5, "Digital", "Digital", "Digital", "Tradicional").alias("tipo_da_conta"),
            pick(7, "Baixo", "Baixo", "Medio", "Medio", "Medio", "Alto").alias("gp_score_de_credito"),
            F.when(F.col("n_orders") < 8, "Baixo").when(F.col("n_orders") < 12, "Medio")
            .otherwise("Alto").alias("gp_limite_do_cartao"),
            pick(3, "< 2 anos", "2-5 anos", "> 5 anos").alias("tempo_conta_atv"),
            flag("f_open").alias("outros_bancos"),
            flag("f_part").alias("emprestimo"),
            flag("f_high").alias("financiamento"),
            flag("f_medium").alias("cartao_de_credito"),
            flag("f_unset").alias("usa_cheque"),
            flag("f_large").alias("atrasa_pag"),
            F.when(balance > 5000, 1).otherwise(0).alias("investimentos"),
            flag("f_urgent").alias("usa_pix"),
            flag("f_low").alias("usa_ebanking"),
            flag("f_done").alias("usa_app_banco"),
            F.when(key % 97 == 0, None).when(spend > 2500000, 1).otherwise(0).alias("adesao"),
        )
    )


def students(spark: SparkSession, base_dir: str) -> DataFrame:
    """One survey row per line item. ``row_key`` is unique; ``id`` is not."""
    part, supp, order, line = (F.col(c) for c in ("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"))
    return read_table(spark, base_dir, "lineitem").select(
        F.concat_ws("-", order, line, part, supp).alias("row_key"),
        order.alias("id"),
        (10 + part % 64).cast("int").alias("age"),
        F.when(F.col("l_linestatus") == "F", "Female").otherwise("Male").alias("gender"),
        F.when(supp % 37 == 0, "Others").when(F.col("l_returnflag") == "A", "Unhealthy")
        .when(F.col("l_returnflag") == "N", "Moderate").otherwise("Healthy").alias("dietary_habits"),
        F.when(line <= 2, "'Less than 5 hours'").when(line == 3, "'5-6 hours'")
        .when(line <= 5, "'7-8 hours'").when(line == 6, "'More than 8 hours'")
        .otherwise("Others").alias("sleep_duration"),
        F.when(F.col("l_tax") > 0.04, "Yes").otherwise("No").alias("suicidal_thoughts"),
        F.when(part % 71 != 0, F.col("l_quantity") / 5).alias("cgpa"),
        (supp % 6).cast("double").alias("academic_pressure"),
        (order % 6).cast("double").alias("study_satisfaction"),
        F.when(F.col("l_discount") > 0.04, 1).otherwise(0).alias("depression"),
    )
