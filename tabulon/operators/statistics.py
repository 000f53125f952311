"""Group statistics of the client table and stable pages of its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulon.functions.expressions import quoted
from tabulon.operators.bounded import numbered

# The columns a page of clients shows, in order.
PAGE_COLUMNS = [
    "estado", "faixa_etaria", "sexo", "escolaridade", "renda", "gp_renda",
    "gp_gasto_mensal", "gp_score_de_credito", "adesao", "usa_pix",
    "usa_ebanking", "usa_app_banco",
]

# Keys whose rows are counted together when a page is looked up.
SPAN = 10_000

TOTALS = ["total", "aderiu", "nao_aderiu", "taxa_adesao"]


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with two decimals, 0 for an empty whole."""
    return F.coalesce(F.round(F.try_divide(part, whole) * 100, 2), F.lit(0.0))


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def overall(df: DataFrame, label: str = "adesao") -> DataFrame:
    """Totals and adoption rate. Rows without a label count as non-adopters
    here and are also reported on their own."""
    adopters = F.count_if(F.col(label) == 1)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        adopters.alias("aderiu"),
        F.count_if(F.col(label).isNull()).alias("label_missing"),
    ).select(
        "total", "aderiu", (F.col("total") - F.col("aderiu")).alias("nao_aderiu"),
        percent(F.col("aderiu"), F.col("total")).alias("taxa_adesao"), "label_missing",
    )


def by_state(df: DataFrame, state: str = "estado", label: str = "adesao") -> DataFrame:
    """Adopters and non-adopters per state; rows without a label are left out
    of both, and a state with no labelled row keeps null sums."""
    return df.groupBy(state).agg(
        F.sum(F.col(label).cast("long")).alias("aderiu"),
        F.sum((1 - F.col(label)).cast("long")).alias("nao_aderiu"),
    ).withColumn("count", F.col("aderiu") + F.col("nao_aderiu"))


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """Row count per key combination, null keys kept."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def all_statistics(
    df: DataFrame,
    state: str = "estado",
    age: str = "faixa_etaria",
    income: str = "gp_renda",
    label: str = "adesao",
) -> DataFrame:
    """Every statistic of the table from one scan.

    Rows are first counted per (state, age, income, label), which the map side
    already reduces to a few thousand rows. The sections then work on those
    counts, sharing the one shuffle that made them. The totals are an aggregate
    of their own, so that an empty table has them too.
    """
    cells = df.groupBy(state, age, income, label).agg(F.count(F.lit(1)).alias("n"))
    # the label is both a grouping key and an input, so the input gets a copy
    cells = cells.withColumn("y", F.col(label).cast("long"))
    n, y = F.col("n"), F.col("y")
    nothing = {"count": "long", "aderiu": "long", "nao_aderiu": "long", "taxa_adesao": "double", "label_missing": "long"}

    def shaped(rows: DataFrame, section, **figures) -> DataFrame:
        keys = [
            (F.col(k) if k in rows.columns else F.lit(None)).cast(kind).alias(k)
            for k, kind in ((state, "string"), (age, "string"), (income, "string"), (label, "int"))
        ]
        values = [figures.get(f, F.lit(None)).cast(kind).alias(f) for f, kind in nothing.items()]
        return rows.select(section.alias("section"), *keys, *values)

    # grouping_id sets a bit per rolled-up column, state being the highest
    groups = cells.groupingSets([[state], [age], [income, label]], state, age, income, label).agg(
        F.grouping_id(state, age, income, label).alias("g"),
        F.sum("n").alias("rows"), F.sum(y * n).alias("ones"), F.sum((1 - y) * n).alias("zeros"),
    )
    is_state = F.col("g") == 0b0111
    section = F.when(is_state, "state").when(F.col("g") == 0b1011, "age").otherwise("income_label")
    grouped = shaped(
        groups, section,
        count=F.when(is_state, F.col("ones") + F.col("zeros")).otherwise(F.col("rows")),
        aderiu=F.when(is_state, F.col("ones")), nao_aderiu=F.when(is_state, F.col("zeros")),
    )

    def counted(condition):
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    totals = cells.agg(
        counted(F.lit(True)).alias("rows"), counted(y == 1).alias("ones"), counted(y.isNull()).alias("unlabelled")
    )
    rows, ones = F.col("rows"), F.col("ones")
    return grouped.unionByName(shaped(
        totals, F.lit("overall"), count=rows, aderiu=ones, nao_aderiu=rows - ones,
        taxa_adesao=percent(ones, rows), label_missing=F.col("unlabelled"),
    ))


def statistics_record(
    df: DataFrame,
    state: str = "estado",
    age: str = "faixa_etaria",
    income: str = "gp_renda",
    label: str = "adesao",
) -> DataFrame:
    """The statistics as one nested record: totals plus an array per section.

    Only the grouped rows are gathered, so the record grows with the number of
    groups. Use :func:`all_statistics` when a grouping column is unbounded.
    """
    stats = all_statistics(df, state, age, income, label)
    section = F.col("section")

    def rows(name, *columns):
        return F.array_sort(F.collect_list(F.when(section == name, F.struct(*columns))))

    def total(name):
        return F.max(F.when(section == "overall", F.col(name)))

    return stats.agg(
        F.struct(
            total("count").alias("total_clientes"), total("aderiu").alias("aderiu"),
            total("nao_aderiu").alias("nao_aderiu"), total("taxa_adesao").alias("taxa_adesao"),
        ).alias("geral"),
        rows("state", state, "aderiu", "nao_aderiu", "count").alias("por_estado"),
        rows("age", age, "count").alias("por_faixa_etaria"),
        rows("income_label", income, label, "count").alias("por_renda"),
    )


def page(df: DataFrame, key: str, limit: int = 1000, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in key order, ties in the order of
    the other columns, so that neighbouring pages never overlap.

    Only keys are counted and put in order, to find the two that bound the page;
    the rows between them are then merged from all tasks, which keep no more than
    the page and the bounding keys' own ties. :func:`page_after` needs no bounds.
    """
    counts = df.groupBy(quoted(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    placed = numbered(counts, [F.asc("k")], "place")
    # keys of one range of places are counted together, so the running sum is short
    spans = placed.groupBy(F.floor(F.col("place") / SPAN).alias("span")).agg(F.sum("n").alias("rows"))
    up_to = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumn("end", F.sum("rows").over(up_to)).withColumn("start", F.col("end") - F.col("rows"))
    inside = (F.col("end") > offset) & (F.col("start") < offset + limit)
    near = placed.join(F.broadcast(spans.filter(inside)), F.floor(F.col("place") / SPAN) == F.col("span"))
    before = Window.partitionBy("span").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("start") + F.coalesce(F.sum("n").over(before), F.lit(0))
    keys = near.withColumn("first", first).filter((F.col("first") + F.col("n") > offset) & (F.col("first") < offset + limit))
    low = keys.agg(F.min(F.struct("first", "k")).alias("low"), F.max(F.struct("first", "k")).alias("high")).first()
    if low is None or low["low"] is None:
        return df.limit(0)
    bounds = [low["low"]["k"], low["high"]["k"]]
    value = quoted(key)
    chosen = df.filter(_from(value, bounds[0]) & _until(value, bounds[1]))
    ties = [quoted(c).asc() for c, kind in df.dtypes if c != key and not kind.startswith("map")]
    return chosen.orderBy(value.asc(), *ties).offset(offset - low["low"]["first"]).limit(limit)


def _from(value: Column, low) -> Column:
    """At or after a key in ascending order, where null comes first."""
    return F.lit(True) if low is None else value >= F.lit(low)


def _until(value: Column, high) -> Column:
    return value.isNull() if high is None else value.isNull() | (value <= F.lit(high))


def page_after(df: DataFrame, key: str, last_key, limit: int = 1000) -> DataFrame:
    """The next page after the last key seen; the filter reaches the scan."""
    return df.filter(F.col(key) > F.lit(last_key)).orderBy(key).limit(limit)


def _totals(df: DataFrame, label: str) -> Column:
    """The table's totals as one scalar subquery, so that one scan gives all."""
    return overall(df, label).select(F.struct(*TOTALS)).scalar()


def page_with_totals(
    df: DataFrame,
    key: str,
    limit: int = 1000,
    offset: int = 0,
    columns: list[str] | None = None,
    label: str = "adesao",
) -> DataFrame:
    """Page rows, each carrying the statistics of the whole table."""
    wanted = [c for c in columns or PAGE_COLUMNS if c in df.columns]
    rows = page(df.select(key, *[c for c in wanted if c != key]), key, limit, offset)
    return rows.withColumn("__totals", _totals(df, label)).select(
        *rows.columns, *[F.col("__totals")[f].alias(f) for f in TOTALS]
    )


def page_record(
    df: DataFrame,
    key: str,
    limit: int = 1000,
    offset: int = 0,
    columns: list[str] | None = None,
    label: str = "adesao",
) -> DataFrame:
    """One record: record counts, totals and the page as an array of rows."""
    wanted = [c for c in columns or PAGE_COLUMNS if c in df.columns]
    rows = page(df.select(key, *[c for c in wanted if c != key]), key, limit, offset)
    data = rows.agg(
        F.count(F.lit(1)).alias("returned_records"),
        F.array_sort(F.collect_list(F.struct(key, *[c for c in wanted if c != key]))).alias("data"),
    )
    return data.withColumn("statistics", _totals(df, label)).select(
        F.col("statistics.total").alias("total_records"), "returned_records", "statistics", "data"
    )


def first_row(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(key).limit(1)


def top(df: DataFrame, score: str, tie: str, k: int | None = None) -> DataFrame:
    """Descending by score with ties by name; the first ``k`` if given."""
    ordered = df.orderBy(F.desc(score), tie)
    return ordered if k is None else ordered.limit(k)
