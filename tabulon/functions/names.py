"""Column spellings: stored (spaces, accents), request (ASCII) and table form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulon.functions.expressions import quoted

# Request field -> (stored column, table column), categories
# first, then the 0/1 flags, in the order the model expects them.
CATEGORY_NAMES = {
    "Faixa_etaria": ("Faixa etária", "faixa_etaria"),
    "Estado": ("Estado", "estado"),
    "Sexo": ("Sexo", "sexo"),
    "Ocupacao": ("Ocupacao", "ocupacao"),
    "Escolaridade": ("Escolaridade", "escolaridade"),
    "Gp_renda": ("Gp renda", "gp_renda"),
    "Tipo_da_conta": ("Tipo_da_conta", "tipo_da_conta"),
    "Gp_score_de_credito": ("Gp score de crédito", "gp_score_de_credito"),
    "Gp_limite_do_cartao": ("Gp limite do cartão", "gp_limite_do_cartao"),
    "Tempo_conta_atv": ("Tempo_conta_atv", "tempo_conta_atv"),
}
FLAG_NAMES = {
    "Outros_bancos": ("Outros_bancos", "outros_bancos"),
    "Emprestimo": ("Emprestimo", "emprestimo"),
    "Financiamento": ("Financiamento", "financiamento"),
    "Cartao_de_credito": ("Cartao_de_credito", "cartao_de_credito"),
    "Usa_cheque": ("Usa_cheque", "usa_cheque"),
    "Atrasa_pag": ("Atrasa_pag", "atrasa_pag"),
    "Investimentos": ("Investimentos", "investimentos"),
    "Usa_pix": ("Usa_pix", "usa_pix"),
    "Usa_eBanking": ("Usa_eBanking", "usa_ebanking"),
    "Usa_app_banco": ("Usa_app_banco", "usa_app_banco"),
}
NAMES = {**CATEGORY_NAMES, **FLAG_NAMES}

CATEGORIES = [table for _, table in CATEGORY_NAMES.values()]
FLAGS = [table for _, table in FLAG_NAMES.values()]


def with_underscore_names(df: DataFrame) -> DataFrame:
    """Every column with a space in its name also under an underscored name."""
    extra = {c: c.replace(" ", "_") for c in df.columns if " " in c}
    taken = set(df.columns)
    return df.select(
        *[quoted(c) for c in df.columns],
        *[quoted(c).alias(u) for c, u in extra.items() if u not in taken],
    )


def to_stored_names(df: DataFrame) -> DataFrame:
    """Table columns under their stored spelling; other columns unchanged."""
    stored = {table: kept for kept, table in NAMES.values()}
    return df.select(*[quoted(c).alias(stored.get(c, c)) for c in df.columns])


def to_request_names(df: DataFrame) -> DataFrame:
    request = {table: asked for asked, (_, table) in NAMES.items()}
    return df.select(*[quoted(c).alias(request.get(c, c)) for c in df.columns])


def _first_given(df: DataFrame, request: str, stored: str) -> Column:
    """Request spelling, or the stored one where the first is null or empty."""
    kinds = dict(df.dtypes)

    def given(name: str) -> Column:
        return F.nullif(quoted(name), F.lit("")) if kinds[name] == "string" else quoted(name)

    found = [given(n) for n in dict.fromkeys((request, stored)) if n in kinds]
    return F.coalesce(*found) if found else F.lit(None)


def to_table_names(df: DataFrame, keep: tuple[str, ...] = (), others: bool = False) -> DataFrame:
    """The twenty model inputs under table names, from either spelling; with
    ``others``, every column that is no spelling of an input stays too."""
    inputs = [_first_given(df, asked, kept).alias(table) for asked, (kept, table) in NAMES.items()]
    spelled = {n for asked, (kept, table) in NAMES.items() for n in (asked, kept, table)}
    more = [c for c in df.columns if c not in spelled and c not in keep] if others else []
    return df.select(*[quoted(c) for c in (*keep, *more)], *inputs)


# Stored columns that are no model inputs -> table columns.
OTHER_NAMES = {"Renda": "renda", "Gp gasto mensal": "gp_gasto_mensal", "Adesao_ao_OPF": "adesao"}


def from_stored_names(df: DataFrame, key: str = "client_id") -> DataFrame:
    """A table in its stored spelling under table names, other columns unchanged.

    Without a column ``key``, one is made from the row's content: equal rows are
    numbered, so that every row has its own key, the same on every run.
    """
    table = {stored: name for stored, name in NAMES.values()} | OTHER_NAMES
    named = df.select(*[quoted(c).alias(table.get(c, c)) for c in df.columns])
    if key in named.columns:
        return named
    content = F.md5(F.to_json(F.struct(*[quoted(c) for c in named.columns]), {"ignoreNullFields": "false"}))
    place = F.row_number().over(Window.partitionBy("__content").orderBy("__content"))
    marked = named.withColumn("__content", content)
    return marked.select(F.concat_ws("-", "__content", place).alias(key), *[quoted(c) for c in named.columns])
