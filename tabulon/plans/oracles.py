"""The catalogue's queries as SQL, for checking results on another engine."""

from __future__ import annotations

from itertools import combinations

from tabulon.functions.expressions import AGE_EDGES, AGE_LABELS
from tabulon.functions.names import CATEGORIES, CATEGORY_NAMES, FLAG_NAMES, FLAGS, NAMES
from tabulon.operators.statistics import PAGE_COLUMNS

CLIENTS = """activity AS (
  SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS spend,
         max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS f_urgent,
         max(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS f_high,
         max(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END) AS f_medium,
         max(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END) AS f_unset,
         max(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS f_low,
         max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f_done,
         max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS f_open,
         max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS f_part,
         max(CASE WHEN o_totalprice > 450000 THEN 1 ELSE 0 END) AS f_large
  FROM orders GROUP BY o_custkey),
clients AS (
  SELECT c_custkey AS client_id,
    CASE WHEN c_custkey % 53 = 0 THEN NULL ELSE n_name END AS estado,
    CASE WHEN c_custkey % 6 = 0 THEN '18-24' WHEN c_custkey % 6 = 1 THEN '25-34'
         WHEN c_custkey % 6 = 2 THEN '35-44' WHEN c_custkey % 6 = 3 THEN '45-54'
         WHEN c_custkey % 6 = 4 THEN '55-64' ELSE '65+' END AS faixa_etaria,
    CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sexo,
    c_mktsegment AS ocupacao,
    CASE WHEN c_custkey % 4 = 0 THEN 'Fundamental' WHEN c_custkey % 4 = 1 THEN 'Medio'
         WHEN c_custkey % 4 = 2 THEN 'Superior' ELSE 'Pos' END AS escolaridade,
    CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE c_acctbal END AS renda,
    CASE WHEN c_acctbal < 3000 THEN 'Baixa' WHEN c_acctbal < 7000 THEN 'Media' ELSE 'Alta' END AS gp_renda,
    CASE WHEN spend < 1500000 THEN 'Baixo' WHEN spend < 3000000 THEN 'Medio'
         WHEN spend IS NOT NULL THEN 'Alto' END AS gp_gasto_mensal,
    CASE WHEN c_custkey % 5 < 3 THEN 'Digital' ELSE 'Tradicional' END AS tipo_da_conta,
    CASE WHEN c_custkey % 7 < 2 THEN 'Baixo' WHEN c_custkey % 7 < 5 THEN 'Medio' ELSE 'Alto' END AS gp_score_de_credito,
    CASE WHEN n_orders < 8 THEN 'Baixo' WHEN n_orders < 12 THEN 'Medio' ELSE 'Alto' END AS gp_limite_do_cartao,
    CASE WHEN c_custkey % 3 = 0 THEN '< 2 anos' WHEN c_custkey % 3 = 1 THEN '2-5 anos' ELSE '> 5 anos' END AS tempo_conta_atv,
    coalesce(f_open, 0) AS outros_bancos, coalesce(f_part, 0) AS emprestimo,
    coalesce(f_high, 0) AS financiamento, coalesce(f_medium, 0) AS cartao_de_credito,
    coalesce(f_unset, 0) AS usa_cheque, coalesce(f_large, 0) AS atrasa_pag,
    CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS investimentos,
    coalesce(f_urgent, 0) AS usa_pix, coalesce(f_low, 0) AS usa_ebanking,
    coalesce(f_done, 0) AS usa_app_banco,
    CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN spend > 2500000 THEN 1 ELSE 0 END AS adesao
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN activity ON o_custkey = c_custkey)"""

STUDENTS = """students AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_key,
    l_orderkey AS id, CAST(10 + l_partkey % 64 AS INT) AS age,
    CASE WHEN l_linestatus = 'F' THEN 'Female' ELSE 'Male' END AS gender,
    CASE WHEN l_suppkey % 37 = 0 THEN 'Others' WHEN l_returnflag = 'A' THEN 'Unhealthy'
         WHEN l_returnflag = 'N' THEN 'Moderate' ELSE 'Healthy' END AS dietary_habits,
    CASE WHEN l_linenumber <= 2 THEN '''Less than 5 hours''' WHEN l_linenumber = 3 THEN '''5-6 hours'''
         WHEN l_linenumber <= 5 THEN '''7-8 hours''' WHEN l_linenumber = 6 THEN '''More than 8 hours'''
         ELSE 'Others' END AS sleep_duration,
    CASE WHEN l_tax > 0.04 THEN 'Yes' ELSE 'No' END AS suicidal_thoughts,
    CASE WHEN l_partkey % 71 = 0 THEN NULL ELSE l_quantity / 5 END AS cgpa,
    CAST(l_suppkey % 6 AS DOUBLE) AS academic_pressure,
    CAST(l_orderkey % 6 AS DOUBLE) AS study_satisfaction,
    CASE WHEN l_discount > 0.04 THEN 1 ELSE 0 END AS depression
  FROM lineitem)"""

STUDENT_COLUMNS = [
    "row_key", "id", "age", "gender", "dietary_habits", "sleep_duration", "suicidal_thoughts",
    "cgpa", "academic_pressure", "study_satisfaction", "depression",
]
STUDENT_TYPES = [
    "string", "bigint", "int", "string", "string", "string", "string", "double", "double", "double", "int",
]
SURVEY_COLUMNS = STUDENT_COLUMNS[2:]
SURVEY_NUMBERS = ["age", "cgpa", "academic_pressure", "study_satisfaction", "depression"]
SLEEP = ["'5-6 hours'", "'7-8 hours'", "'Less than 5 hours'", "'More than 8 hours'", "Others"]
GENDERS = ["Female", "Male"]
ANSWERS = ["No", "Yes"]
TRAINING_COLUMNS = (
    ["academic_pressure", "cgpa", "study_satisfaction", "age_group_encoded", "dietary_encoded"]
    + [f"gender_{v}" for v in GENDERS]
    + [f"suicidal_thoughts_{v}" for v in ANSWERS]
    + [f"sleep_duration_{v}" for v in SLEEP]
)


def _with(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def _clients(select: str, *ctes: str) -> str:
    return _with(CLIENTS, *ctes, select=select)


def _students(select: str, *ctes: str) -> str:
    return _with(STUDENTS, *ctes, select=select)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


def _age_group(column: str = "age") -> str:
    ranges = " ".join(
        f"WHEN {column} > {low} AND {column} <= {high} THEN '{label}'"
        for low, high, label in zip(AGE_EDGES, AGE_EDGES[1:], AGE_LABELS)
    )
    return f"CASE {ranges} END"


def _indicator(column: str, value: str) -> str:
    return f'CASE WHEN {column} = {_text(value)} THEN 1 ELSE 0 END AS "{column}_{value}"'


def _indicators(column: str, values: list[str]) -> str:
    return ", ".join(_indicator(column, v) for v in values)


RATE = "coalesce(round(100.0 * count(*) FILTER (WHERE adesao = 1) / nullif(count(*), 0), 2), 0)"
ADOPTERS = "CAST(count(*) FILTER (WHERE adesao = 1) AS BIGINT)"
DIET_CODE = "CAST(CASE dietary_habits WHEN 'Unhealthy' THEN 0 WHEN 'Moderate' THEN 1 WHEN 'Healthy' THEN 2 END AS DOUBLE)"

# survey rows with the age group and its dense code, null coded last
SURVEY = f"""kept AS (SELECT *, {_age_group()} AS age_group FROM students
  WHERE dietary_habits IN ('Unhealthy', 'Moderate', 'Healthy')),
age_codes AS (SELECT age_group AS g, CAST(row_number() OVER (ORDER BY age_group NULLS LAST) - 1 AS BIGINT) AS code
  FROM (SELECT DISTINCT age_group FROM kept))"""

SCORED = """scored AS (SELECT row_key, depression AS y, age + academic_pressure AS score,
  CASE WHEN age + academic_pressure > 45 THEN 1.0 ELSE 0.0 END AS p FROM students)"""


def _statistics() -> dict[str, str]:
    n = "CAST(count(*) AS BIGINT)"
    state_sums = "CAST(sum(adesao) AS BIGINT) AS aderiu, CAST(sum(1 - adesao) AS BIGINT) AS nao_aderiu"
    page = ", ".join(["client_id", *PAGE_COLUMNS])
    return {
        "stats_overall": _clients(
            f"""SELECT {n} AS total, {ADOPTERS} AS aderiu, {n} - {ADOPTERS} AS nao_aderiu,
  {RATE} AS taxa_adesao, CAST(count(*) FILTER (WHERE adesao IS NULL) AS BIGINT) AS label_missing FROM clients"""
        ),
        "stats_by_state": _clients(
            f"""SELECT estado, {state_sums}, CAST(sum(adesao) + sum(1 - adesao) AS BIGINT) AS count
FROM clients GROUP BY estado"""
        ),
        "stats_by_age": _clients(f"SELECT faixa_etaria, {n} AS count FROM clients GROUP BY faixa_etaria"),
        "stats_income_label": _clients(
            f"SELECT gp_renda, adesao, {n} AS count FROM clients GROUP BY gp_renda, adesao"
        ),
        "stats_all": _clients(
            f"""SELECT 'state' AS section, estado, NULL AS faixa_etaria, NULL AS gp_renda, CAST(NULL AS INT) AS adesao,
  CAST(sum(adesao) + sum(1 - adesao) AS BIGINT) AS count, {state_sums},
  CAST(NULL AS DOUBLE) AS taxa_adesao, CAST(NULL AS BIGINT) AS label_missing
FROM clients GROUP BY estado
UNION ALL SELECT 'age', NULL, faixa_etaria, NULL, NULL, {n}, NULL, NULL, NULL, NULL FROM clients GROUP BY faixa_etaria
UNION ALL SELECT 'income_label', NULL, NULL, gp_renda, adesao, {n}, NULL, NULL, NULL, NULL
  FROM clients GROUP BY gp_renda, adesao
UNION ALL SELECT 'overall', NULL, NULL, NULL, NULL, {n}, {ADOPTERS}, {n} - {ADOPTERS}, {RATE},
  CAST(count(*) FILTER (WHERE adesao IS NULL) AS BIGINT) FROM clients"""
        ),
        "statistics_record": _clients(
            f"""SELECT 'geral' AS part, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS INT) AS adesao, {n} AS count, {ADOPTERS} AS aderiu,
  {n} - {ADOPTERS} AS nao_aderiu, {RATE} AS taxa_adesao FROM clients
UNION ALL SELECT 'estado', estado, NULL, CAST(sum(adesao) + sum(1 - adesao) AS BIGINT), {state_sums}, NULL FROM clients GROUP BY estado
UNION ALL SELECT 'faixa_etaria', faixa_etaria, NULL, {n}, NULL, NULL, NULL FROM clients GROUP BY faixa_etaria
UNION ALL SELECT 'renda', gp_renda, adesao, {n}, NULL, NULL, NULL FROM clients GROUP BY gp_renda, adesao"""
        ),
        "page_record": _clients(
            f"""SELECT t.total AS total_records, CAST(count(*) OVER () AS BIGINT) AS returned_records, t.aderiu AS total_aderiu, t.taxa_adesao, {page}
FROM (SELECT * FROM clients ORDER BY client_id LIMIT 25 OFFSET 50)
CROSS JOIN (SELECT {n} AS total, {ADOPTERS} AS aderiu, {RATE} AS taxa_adesao FROM clients) t"""
        ),
        "table_shape": _students(f"SELECT {n} AS n_rows, {len(STUDENT_COLUMNS)} AS n_columns FROM students"),
        "clients_page": _clients(f"SELECT {page} FROM clients ORDER BY client_id LIMIT 50 OFFSET 100"),
        "clients_page_after": _clients(
            f"SELECT {page} FROM clients WHERE client_id > 80 ORDER BY client_id LIMIT 50"
        ),
        "clients_page_totals": _clients(
            f"""SELECT {page}, t.total, t.aderiu, t.total - t.aderiu AS nao_aderiu, t.taxa_adesao
FROM (SELECT * FROM clients ORDER BY client_id LIMIT 25 OFFSET 50)
CROSS JOIN (SELECT {n} AS total, {ADOPTERS} AS aderiu, {RATE} AS taxa_adesao FROM clients) t"""
        ),
        "first_row": _clients("SELECT * FROM clients ORDER BY client_id LIMIT 1"),
        "top_scores": _students(
            "SELECT row_key, age + academic_pressure AS score FROM students ORDER BY score DESC, row_key LIMIT 20"
        ),
        "preview_rows": _students("SELECT * FROM students ORDER BY row_key LIMIT 10"),
    }


def _columns() -> dict[str, str]:
    stored = {table: kept for kept, table in NAMES.values()}
    others = ["client_id", "renda", "gp_gasto_mensal", "adesao"]
    fields = [*others[:1], *CATEGORIES, *others[1:3], *FLAGS, *others[3:]]
    named = [f'{c} AS "{stored.get(c, c)}"' for c in fields]
    spaced = [f'{c} AS "{stored[c].replace(" ", "_")}"' for c in CATEGORIES if " " in stored[c]]

    def raw(asked, table):
        """The text a record carries, with some fields broken on purpose."""
        if table == "estado":
            return "CASE WHEN client_id % 11 = 0 THEN NULL ELSE estado END"
        if table == "usa_pix":
            return "CASE WHEN client_id % 13 = 0 THEN 'yes' WHEN client_id % 19 = 0 THEN '1d' WHEN client_id % 23 = 0 THEN '1e0' ELSE CAST(usa_pix AS VARCHAR) END"
        if table == "usa_cheque":
            return "CASE WHEN client_id % 17 = 0 THEN CAST(usa_cheque AS VARCHAR) || '.5' ELSE CAST(usa_cheque AS VARCHAR) END"
        return f"CAST({table} AS VARCHAR)"

    raws = ", ".join(f'{raw(asked, table)} AS "{asked}"' for asked, (_, table) in NAMES.items())
    typed = [f'"{c}"' for c in CATEGORY_NAMES] + [f'CASE WHEN "{c}" IN (\'0\', \'1\') THEN CAST("{c}" AS INT) END AS "{c}"' for c in FLAG_NAMES]
    reasons = [f"CASE WHEN \"{c}\" IS NULL THEN '{c}: missing' END" for c in CATEGORY_NAMES] + [
        f"CASE WHEN \"{c}\" IS NULL THEN '{c}: missing' WHEN \"{c}\" NOT IN ('0', '1')"
        f" THEN '{c}: not an integer' END"
        for c in FLAG_NAMES
    ]
    judged = _clients(
        f"SELECT client_id, reasons = '' AS accepted, nullif(reasons, '') AS reasons, CASE WHEN reasons = '' THEN true END AS score_ok"
        f" FROM (SELECT client_id, concat_ws('; ', {', '.join(reasons)}) AS reasons FROM raw)",
        f"raw AS (SELECT client_id, {raws} FROM clients)",
    )
    return {
        "score_records": judged,
        "stream_scores": judged,
        "csv_texts": "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 11 = 1 THEN ''"
        " WHEN doc_id % 11 = 2 THEN '  ' || text || chr(9) || ' ' ELSE text END AS text FROM documents",
        "scan_parquet": "SELECT * FROM customer",
        "csv_roundtrip": _students("SELECT * FROM students"),
        "parse_records": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
        "typed_payloads": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,"
        " json_extract_string(props, '$.absent') AS absent FROM events",
        "json_rows": """SELECT event_id, CAST(to_json({'event_id': event_id,
  'ts': CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END,
  'day': strftime(ts, '%Y-%m-%d'), 'value': CASE WHEN event_type = 'error' THEN NULL ELSE value END, 'raw': event_type,
  'parts': [event_type, NULL], 'by_user': map([CAST(user_id AS VARCHAR)], [event_id])}) AS VARCHAR) AS json FROM events""",
        "label_cast": _clients("SELECT * EXCLUDE (adesao), CAST(adesao AS DOUBLE) AS label FROM clients"),
        "drop_columns": _students("SELECT * EXCLUDE (id) FROM students"),
        "select_existing": _clients(f"SELECT client_id, {', '.join(PAGE_COLUMNS)} FROM clients"),
        "underscore_alias": _clients(f"SELECT {', '.join(named + spaced)} FROM clients"),
        "name_map": _clients(f"SELECT client_id, {', '.join([*CATEGORIES, *FLAGS])} FROM clients"),
        "equality_filter": _clients("SELECT * FROM clients WHERE adesao = 1"),
        "membership_filter": _students(
            "SELECT * FROM students WHERE dietary_habits IN ('Unhealthy', 'Moderate', 'Healthy')"
        ),
        "drop_null_target": _clients("SELECT * FROM clients WHERE adesao IS NOT NULL"),
        "nan_to_null": _students("SELECT row_key, cgpa FROM students"),
        "columns_by_prefix": _students(
            f"SELECT row_key, academic_pressure, {_indicators('sleep_duration', SLEEP)} FROM students"
        ),
        "features_without_target": _students("SELECT * EXCLUDE (depression) FROM students"),
        "columns_by_type": _students(
            "SELECT id, age, cgpa, academic_pressure, study_satisfaction, depression FROM students"
        ),
        "value_map": _students(
            "SELECT row_key, CASE WHEN suicidal_thoughts = 'Yes' THEN 'Yes' ELSE 'No' END AS thoughts,"
            " CASE depression WHEN 1 THEN 'Depression' END AS mapped FROM students"
        ),
        "prediction_text": _students(
            "SELECT row_key, CASE WHEN p = 1 THEN 'Vai aderir ao Open Finance' ELSE 'Não vai aderir ao Open Finance' END"
            " AS label_text FROM scored", SCORED
        ),
        "validate_records": _clients(
            f"SELECT client_id, {', '.join(typed)}, concat_ws('; ', {', '.join(reasons)}) AS reject_reason FROM raw",
            f"raw AS (SELECT client_id, {raws} FROM clients)",
        ),
    }


def _profiles() -> dict[str, str]:
    n = "CAST(count(*) AS BIGINT) AS count"
    survey = ", ".join(SURVEY_COLUMNS)
    counts = _union([
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, {n} FROM students WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in SURVEY_COLUMNS
    ])
    modes = _union([
        f"""SELECT * FROM (SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS mode, {n} FROM students
  WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count DESC, {c} LIMIT 1)"""
        for c in SURVEY_COLUMNS
    ])
    describe = _union([
        f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS count, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, round(CAST(quantile_cont({c}, 0.25) AS DOUBLE), 6) AS q25,
  round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 6) AS q50, round(CAST(quantile_cont({c}, 0.75) AS DOUBLE), 6) AS q75,
  CAST(max({c}) AS DOUBLE) AS max FROM students"""
        for c in ["id", *SURVEY_NUMBERS]
    ])
    info = _union([
        f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS type, CAST(count({c}) AS BIGINT) AS non_null,"
        f" CAST(count(*) - count({c}) AS BIGINT) AS missing FROM students"
        for i, (c, t) in enumerate(zip(STUDENT_COLUMNS, STUDENT_TYPES))
    ])
    fields = ["client_id", *CATEGORIES, "renda", "gp_gasto_mensal", *FLAGS, "adesao"]
    missing = _union([
        f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS missing FROM clients" for c in fields
    ])
    kinds = _union([
        f"""SELECT "column", kind, {n} FROM (SELECT '{c}' AS "column", CASE WHEN t IS NULL THEN 'null'
  WHEN regexp_full_match(t, '[+-]?[0-9]+') THEN 'int'
  WHEN regexp_full_match(t, '[+-]?([0-9]+[.][0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN 'float' ELSE 'text' END AS kind
  FROM (SELECT CAST({c} AS VARCHAR) AS t FROM students)) GROUP BY "column", kind"""
        for c in SURVEY_COLUMNS
    ])
    numbers = [*SURVEY_NUMBERS, "gender_Female", "gender_Male"]
    flat = f"""flat AS (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in SURVEY_NUMBERS)},
  CASE WHEN gender = 'Female' THEN 1.0 ELSE 0.0 END AS "gender_Female",
  CASE WHEN gender = 'Male' THEN 1.0 ELSE 0.0 END AS "gender_Male" FROM students)"""
    corr = [f"SELECT '{c}' AS x, '{c}' AS y, 1.0 AS r" for c in numbers]
    for a, b in combinations(numbers, 2):
        for x, y in ((a, b), (b, a)):
            corr.append(f"SELECT '{x}', '{y}', round(corr(\"{a}\", \"{b}\"), 6) FROM flat")

    def box(group, value, select_group):
        return f"""quart AS (SELECT grp, CAST(count(x) AS BIGINT) AS n, quantile_cont(x, 0.25) AS q1,
  quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM pts GROUP BY grp)
SELECT quart.grp AS {group}, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  least(min(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)), q1) AS whisker_low,
  greatest(max(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)), q3) AS whisker_high,
  CAST(count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outliers
FROM pts JOIN quart ON pts.grp = quart.grp GROUP BY quart.grp, n, q1, median, q3"""

    def points(expr, value, table="students"):
        return f"pts AS (SELECT * FROM (SELECT {expr} AS grp, {value} AS x FROM {table}) WHERE grp IS NOT NULL AND x IS NOT NULL)"

    histogram = """r AS (SELECT min(cgpa) AS lo, max(cgpa) AS hi FROM students),
edges AS (SELECT CAST(i AS INT) AS bin, lo + i * ((hi - lo) / 30) AS low,
  CASE WHEN i = 29 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 30) END AS high FROM range(30) t(i), r)
SELECT bin, round(low, 9) AS low, round(high, 9) AS high,
  (SELECT CAST(count(*) AS BIGINT) FROM students WHERE cgpa >= low AND (cgpa < high OR (bin = 29 AND cgpa <= high))) AS count
FROM edges"""
    density = """vals AS (SELECT cgpa AS v, count(*) AS c FROM students WHERE cgpa IS NOT NULL GROUP BY cgpa),
s AS (SELECT min(cgpa) AS lo, max(cgpa) AS hi, stddev_samp(cgpa) * power(count(cgpa), -0.2) AS h, count(cgpa) AS n FROM students),
grid AS (SELECT CAST(i AS INT) AS point, lo + i * ((hi - lo) / 199) AS x, h, n FROM range(200) t(i), s)
SELECT point, round(x, 6) AS x, round(sum(c * exp(-((x - v) / h) * ((x - v) / h) / 2)) / (n * h * sqrt(2 * pi())), 6) AS density
FROM grid, vals GROUP BY point, x, n, h"""
    return {
        "value_counts": _students(counts),
        "target_balance": _students(f"SELECT depression, {n} FROM students GROUP BY depression"),
        "describe": _students(describe),
        "column_info": _students(info),
        "missing_counts": _clients(missing),
        "duplicate_count": _students(
            f"SELECT CAST(sum(c - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS c FROM students GROUP BY {survey})"
        ),
        "drop_duplicates": _students(f"SELECT DISTINCT {survey} FROM students"),
        "kind_census": _students(kinds),
        "modes": _students(modes),
        "column_sums": _students(_union([
            f"SELECT 'gender_{v}' AS \"column\", CAST(count(*) FILTER (WHERE gender = '{v}') AS DOUBLE) AS sum FROM students"
            for v in GENDERS
        ])),
        "corr_matrix": _students(_union(corr), flat),
        "count_table": _students(
            f"SELECT sleep_duration, suicidal_thoughts, {n} FROM students GROUP BY sleep_duration, suicidal_thoughts"
        ),
        "cross_table": _students(
            'SELECT sleep_duration, CAST(count(*) FILTER (WHERE depression = 0) AS BIGINT) AS "0",'
            ' CAST(count(*) FILTER (WHERE depression = 1) AS BIGINT) AS "1" FROM students GROUP BY sleep_duration'
        ),
        "box_satisfaction_by_age": "WITH " + STUDENTS + ",\n"
        + points(_age_group(), "study_satisfaction") + ",\n" + box("age_group", "study_satisfaction", ""),
        "box_cgpa_by_label": "WITH " + STUDENTS + ",\n" + points("depression", "cgpa") + ",\n"
        + box("depression", "cgpa", ""),
        "box_price_by_flag": "WITH " + points("l_returnflag", "l_extendedprice * l_discount * l_tax", "lineitem") + ",\n"
        + box("l_returnflag", "x", ""),
        "histogram": "WITH " + STUDENTS + ",\n" + histogram,
        "density": "WITH " + STUDENTS + ",\n" + density,
        "medians": _students(_union([
            f"SELECT '{c}' AS \"column\", CAST(count({c}) AS BIGINT) AS n, round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 6) AS median FROM students"
            for c in SURVEY_NUMBERS
        ])),
        "price_quantiles": _union([
            f"SELECT '{c}' AS \"column\", CAST(count({c}) AS BIGINT) AS n, round(quantile_cont({c}, 0.01), 6) AS p01,"
            f" round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.99), 6) AS p99 FROM lineitem"
            for c in ("l_extendedprice", "l_quantity")
        ]),
    }


def _features() -> dict[str, str]:
    ranks = [
        f"rank_{c} AS (SELECT {c} AS v, row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS i,"
        f" count(*) OVER () AS n FROM clients WHERE {c} IS NOT NULL GROUP BY {c})"
        for c in CATEGORIES
    ]
    joins = " ".join(f"LEFT JOIN rank_{c} ON clients.{c} = rank_{c}.v" for c in CATEGORIES)
    index = {
        c: f"CAST(coalesce(rank_{c}.i, (SELECT max(n) FROM rank_{c})) AS DOUBLE)" for c in CATEGORIES
    }
    indexed = ", ".join(f"{expr} AS {c}_idx" for c, expr in index.items())
    vector = " || ',' || ".join(
        [f"CAST(CAST({e} AS INT) AS VARCHAR)" for e in index.values()] + [f"CAST(clients.{c} AS VARCHAR)" for c in FLAGS]
    )
    survey_hot = ", ".join(
        [_indicators("sleep_duration", SLEEP), _indicators("gender", GENDERS), _indicators("suicidal_thoughts", ANSWERS)]
    )
    encoded = f"""row_key, age, dietary_habits, cgpa, academic_pressure, study_satisfaction, depression, id,
  age_group, code AS age_group_encoded, {DIET_CODE} AS dietary_encoded, {survey_hot}"""
    join_codes = "FROM kept LEFT JOIN age_codes ON age_group IS NOT DISTINCT FROM g"
    median = "(SELECT quantile_cont(renda, 0.5) FROM {0})"
    hot = [
        ("estado", None), ("faixa_etaria", ["18-24", "25-34", "35-44", "45-54", "55-64", "65+"]),
        ("gp_renda", ["Alta", "Baixa", "Media"]),
    ]
    dropped = ", ".join(_indicators(c, v[1:]) for c, v in hot if v)
    aligned = ", ".join(
        f'CAST({c} AS DOUBLE) AS {c}' for c in TRAINING_COLUMNS[:3]
    ) + f""", CAST(code AS DOUBLE) AS age_group_encoded, {DIET_CODE} AS dietary_encoded, """ + ", ".join(
        f"CAST(CASE WHEN {c} = {_text(v)} THEN 1 ELSE 0 END AS DOUBLE) AS \"{c}_{v}\""
        for c, values in (("gender", GENDERS), ("suicidal_thoughts", ANSWERS), ("sleep_duration", SLEEP))
        for v in values
    )
    bucket = "CAST('0x' || substr(md5(CAST({0} AS VARCHAR) || ':42'), 1, 8) AS BIGINT) % 100 < 80"
    feature_list = " UNION ALL ".join(
        f"SELECT {i} AS pos, {_text(f)} AS feature" for i, f in enumerate(TRAINING_COLUMNS[:9])
    )
    return {
        "string_index": _clients(f"SELECT client_id, {indexed} FROM clients {joins}", *ranks),
        "frequency_codes": """WITH t AS (SELECT l_orderkey, l_linenumber,
  CASE WHEN l_partkey % 50 <> 0 THEN CAST(l_partkey AS VARCHAR) END AS part FROM lineitem),
codes AS (SELECT part AS v, row_number() OVER (ORDER BY count(*) DESC, part) - 1 AS i FROM t WHERE part IS NOT NULL GROUP BY part)
SELECT l_orderkey, l_linenumber, part, CAST(coalesce(i, (SELECT count(*) FROM codes)) AS DOUBLE) AS part_code
FROM t LEFT JOIN codes ON part = v""",
        "assemble": _clients(f"SELECT client_id, {vector} AS features FROM clients {joins}", *ranks),
        "age_bins": _students(f"SELECT row_key, age, {_age_group()} AS age_group FROM students"),
        "label_encode": _students(
            f"SELECT row_key, age_group, code AS age_group_encoded {join_codes}", SURVEY
        ),
        "ordinal_encode": _students(
            f"SELECT row_key, dietary_habits, {DIET_CODE} AS dietary_encoded FROM kept", SURVEY
        ),
        "one_hot": _students(
            f"SELECT * EXCLUDE (sleep_duration, gender), {_indicators('sleep_duration', SLEEP)},"
            f" {_indicators('gender', GENDERS)} FROM students"
        ),
        "one_hot_drop_first": _clients(f"SELECT client_id, {dropped} FROM clients"),
        "one_hot_text": _clients(
            f"SELECT client_id, renda, {', '.join(_indicators(c, v) for c, v in hot if v)} FROM clients"
        ),
        "one_hot_vector": _clients(
            "SELECT client_id, " + " || ',' || ".join(
                f"CASE WHEN faixa_etaria = '{v}' THEN '1' ELSE '0' END" for v in hot[1][1]
            ) + " AS faixa_etaria_onehot FROM clients"
        ),
        "align_features": _clients(
            "SELECT CAST(usa_pix AS DOUBLE) AS usa_pix, CAST(0 AS DOUBLE) AS absent, CAST(renda AS DOUBLE) AS renda FROM clients"
        ),
        "one_hot_decode": _students("SELECT row_key, replace(sleep_duration, '''', '') AS sleep_duration FROM students"),
        "median_fill": _clients(
            f"SELECT client_id, coalesce(renda, {median.format('clients')}) AS renda FROM clients"
        ),
        "prepare_training": _clients(
            f"SELECT client_id, coalesce(renda, {median.format('labelled')}) AS renda, adesao, {dropped} FROM labelled",
            "labelled AS (SELECT * FROM clients WHERE adesao IS NOT NULL)",
        ),
        "survey_features": _students(f"SELECT {encoded} {join_codes}", SURVEY),
        "prepare_new_rows": _students(f"SELECT row_key, {aligned} {join_codes}", SURVEY),
        "feature_list": feature_list + _sleep_features(),
        "export_features": _clients(f"SELECT {', '.join(PAGE_COLUMNS)} FROM clients"),
        "split_hash": _students(f"SELECT row_key, {bucket.format('row_key')} AS in_train FROM students"),
        "split_stratified": _students(
            """SELECT row_key, depression, row_number() OVER (PARTITION BY depression ORDER BY md5(row_key || ':42'), row_key)
  <= round(0.2 * count(*) OVER (PARTITION BY depression)) AS in_test FROM students"""
        ),
    }


def _sleep_features() -> str:
    return f"""
UNION ALL SELECT CAST(8 + row_number() OVER (ORDER BY s) AS INT), 'sleep_duration_' || s
FROM (WITH {STUDENTS} SELECT DISTINCT sleep_duration AS s FROM students)"""


def _metrics() -> dict[str, str]:
    counts = """c AS (SELECT y, p, count(*) AS n FROM scored GROUP BY y, p),
k AS (SELECT cls, coalesce(sum(n) FILTER (WHERE y = cls), 0) AS support, coalesce(sum(n) FILTER (WHERE p = cls), 0) AS claimed,
  coalesce(sum(n) FILTER (WHERE y = cls AND p = cls), 0) AS hits FROM c, (VALUES (0), (1)) v(cls) GROUP BY cls),
m AS (SELECT cls, support, hits, coalesce(hits / nullif(claimed, 0), 0) AS precision,
  coalesce(hits / nullif(support, 0), 0) AS recall, coalesce(2 * hits / nullif(claimed + support, 0), 0) AS f1 FROM k)"""
    return {
        "auc": _students(
            """SELECT round((sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
  / (CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) * count(*) FILTER (WHERE y = 0)), 9) AS auc,
  CAST(count(*) FILTER (WHERE y = 1) AS BIGINT) AS positives, CAST(count(*) FILTER (WHERE y = 0) AS BIGINT) AS negatives
FROM (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored)""",
            SCORED,
        ),
        "accuracy": _students("SELECT round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM scored", SCORED),
        "weighted_f1": _students(
            "SELECT round(sum(f1 * support) / sum(support), 9) AS f1 FROM m", SCORED, counts
        ),
        "class_report": _students(
            """SELECT CAST(cls AS VARCHAR) AS class, round(precision, 9) AS precision, round(recall, 9) AS recall,
  round(f1, 9) AS f1, CAST(support AS BIGINT) AS support FROM m
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hits) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9),
  round(sum(f1 * support) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM m""",
            SCORED, counts,
        ),
        "confusion_matrix": _students(
            """SELECT cls AS actual, CAST(count(*) FILTER (WHERE y = cls AND p = 0) AS BIGINT) AS predicted_0,
  CAST(count(*) FILTER (WHERE y = cls AND p = 1) AS BIGINT) AS predicted_1 FROM scored, (VALUES (0), (1)) v(cls) GROUP BY cls""",
            SCORED,
        ),
        "confusion_labels": """SELECT cls AS actual, CAST(count(*) FILTER (WHERE quality = cls AND toxic = 0) AS BIGINT) AS predicted_0,
  CAST(count(*) FILTER (WHERE quality = cls AND toxic = 1) AS BIGINT) AS predicted_1 FROM labels, (VALUES (0), (1)) v(cls) GROUP BY cls""",
        "model_save_load": _clients("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_same FROM clients"),
    }


#: Units that gradients are counted in, and the learner's penalty and least rows and hessian.
UNIT, L2, LEAST_ROWS, LEAST_HESSIAN = 16777216, "0.3::DOUBLE", 20, "0.001"


def _rooted(source: str, features: list[str], label: str, where: str) -> list[str]:
    """Rows in one node with gradients and hessians at the label's odds."""
    listed = ", ".join(f"CAST({f} AS DOUBLE) AS f{i}" for i, f in enumerate(features))
    return [
        f"base AS (SELECT ln(p / (1 - p)) AS start FROM (SELECT avg(CAST({label} AS DOUBLE)) AS p FROM {source} WHERE {where}))",
        f"""at0 AS (SELECT '' AS node, {listed}, {label} AS y, start, CAST(round((1 / (1 + exp(-start)) - {label}) * {UNIT}) AS BIGINT) AS g,
  CAST(round(1 / (1 + exp(-start)) * (1 - 1 / (1 + exp(-start))) * {UNIT}) AS BIGINT) AS h FROM {source}, base WHERE {where})""",
    ]


def _splits(level: int, features: list[str]) -> list[str]:
    """Allowed splits of the nodes of ``at<level>``, both sides for the missing, and the best of each."""
    cells = _union([f"SELECT node, {i} AS feature, f{i} AS v, g, h FROM at{level}" for i in range(len(features))])
    sums = ("g", "h", "n")
    over = "PARTITION BY node, feature"
    to = ", ".join(f"sum({c}) FILTER (WHERE v IS NOT NULL) OVER ({over} ORDER BY v NULLS LAST ROWS UNBOUNDED PRECEDING) AS to_{c}" for c in sums)
    all_ = ", ".join(f"sum({c}) OVER ({over}) AS all_{c}, coalesce(sum({c}) FILTER (WHERE v IS NULL) OVER ({over}), 0) AS gone_{c}" for c in sums)
    left = ", ".join(f"to_{c} + CASE WHEN missing_left THEN gone_{c} ELSE 0 END AS left_{c}" for c in sums)
    score = lambda g, h: f"(CAST({g} AS DOUBLE) / {UNIT}) * (CAST({g} AS DOUBLE) / {UNIT}) / (CAST({h} AS DOUBLE) / {UNIT} + {L2})"
    return [
        f"cell{level} AS (SELECT node, feature, v, CAST(sum(g) AS BIGINT) AS g, CAST(sum(h) AS BIGINT) AS h, count(*) AS n FROM ({cells}) GROUP BY ALL)",
        f"""side{level} AS (SELECT *, {left} FROM (SELECT node, feature, v, max(v) OVER ({over}) AS last, {to}, {all_} FROM cell{level}),
  (VALUES (false), (true)) s(missing_left) WHERE v IS NOT NULL AND (gone_n > 0 OR missing_left = (2 * to_n >= all_n)))""",
        f"""gain{level} AS (SELECT * FROM (SELECT *, {score("left_g", "left_h")} + {score("(all_g - left_g)", "(all_h - left_h)")} - {score("all_g", "all_h")} AS gain
  FROM side{level}) WHERE gain > 0 AND least(left_n, all_n - left_n) >= {LEAST_ROWS} AND least(left_h, all_h - left_h) / CAST({UNIT} AS DOUBLE) >= {LEAST_HESSIAN})""",
        f"""best{level} AS (SELECT * FROM gain{level} QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, v, missing_left) = 1)""",
    ]


def _split_down(level: int, features: list[str]) -> str:
    """Rows of the next level: the letter of their side added, where their node splits."""
    value = "CASE b.feature " + " ".join(f"WHEN {i} THEN f{i}" for i in range(len(features))) + " END"
    side = f"CASE WHEN {value} IS NULL THEN b.missing_left ELSE {value} <= b.v END"
    return f"""at{level + 1} AS (SELECT a.* EXCLUDE (node), CASE WHEN b.node IS NULL THEN a.node WHEN {side} THEN a.node || 'L' ELSE a.node || 'R' END AS node
  FROM at{level} a LEFT JOIN best{level} b ON a.node = b.node)"""


def _first_splits(features: list[str]) -> str:
    names = "CASE feature " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(features)) + " END"
    return f"""SELECT {names} AS feature, CASE WHEN v < last THEN round(v, 6) END AS threshold, missing_left, CAST(left_n AS BIGINT) AS left_rows,
  round(gain, 6) AS gain FROM gain0"""


def _boosted() -> dict[str, str]:
    steps = ["income_step", "usa_pix", "usa_ebanking", "emprestimo", "financiamento", "cartao_de_credito", "atrasa_pag"]
    stepped = "stepped AS (SELECT *, floor(renda / 1000) AS income_step FROM clients)"
    rooted = _rooted("stepped", steps, "adesao", "adesao IS NOT NULL")
    # each node of the second level splits alone, so the tree is the same in any order
    tree = [stepped, *rooted, *_splits(0, steps), _split_down(0, steps), *_splits(1, steps), _split_down(1, steps)]
    value = f"-(CAST(sum(g) AS DOUBLE) / {UNIT}) / (CAST(sum(h) AS DOUBLE) / {UNIT} + {L2})"
    numbers = SURVEY_NUMBERS[:4]
    return {
        "boosted_splits": _students(_first_splits(numbers), *_rooted("students", numbers, "depression", "true"), *_splits(0, numbers)),
        "client_splits": _clients(_first_splits(steps), stepped, *rooted, *_splits(0, steps)),
        "boosted_leaves": _clients(f"SELECT node AS path, CAST(count(*) AS BIGINT) AS rows, round({value}, 9) AS value FROM at2 GROUP BY node", *tree),
        "boosted_confusion": _clients(
            """SELECT CAST(a AS INT) AS actual, CAST(count(*) FILTER (WHERE y = a AND NOT yes) AS BIGINT) AS predicted_0,
  CAST(count(*) FILTER (WHERE y = a AND yes) AS BIGINT) AS predicted_1
FROM (SELECT y, start + value > 0 AS yes FROM at2 JOIN leaf USING (node)), (VALUES (0), (1)) v(a) GROUP BY a""",
            *tree, f"leaf AS (SELECT node, {value} AS value FROM at2 GROUP BY node)"),
    }


def _models() -> dict[str, str]:
    bucket = "CAST('0x' || substr(md5(CAST({0} AS VARCHAR) || ':42'), 1, 8) AS BIGINT) % 100 < 80"
    held_out = f"(SELECT CAST(count(*) AS BIGINT) FROM clients WHERE adesao IS NOT NULL AND NOT ({bucket.format('client_id')}))"
    checks = "true AS sums_to_one, true AS class_follows, true AS text_follows"
    given = ", ".join(f"('{c}', (SELECT count({c}) FROM clients))" for c in (*CATEGORIES, *FLAGS))
    given = f"given AS (SELECT feature, CAST(n AS BIGINT) AS n_given FROM (VALUES {given}) v(feature, n))"
    kinds = ", ".join([*[f"('{c}', 'category')" for c in CATEGORIES], *[f"('{c}', 'number')" for c in FLAGS]])
    order = ", ".join(f"({i}, '{c}', '{c}{suffix}')" for i, (c, suffix) in enumerate(
        [*[(c, "_idx") for c in CATEGORIES], *[(c, "") for c in FLAGS]]))
    metric = "(VALUES ('auc'), ('accuracy'), ('f1')) v(metric)"
    # levels ranked by falling count in the training rows, ties by name; null and unseen follow the last
    training_rows = f"training AS (SELECT * FROM clients WHERE adesao IS NOT NULL AND {bucket.format('client_id')})"
    ranks = [f"r_{c} AS (SELECT {c} AS v, row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS i FROM training WHERE {c} IS NOT NULL GROUP BY {c})"
             for c in CATEGORIES]
    codes = ", ".join(f"CAST(coalesce(r_{c}.i, (SELECT count(*) FROM r_{c})) AS DOUBLE) AS {c}_idx" for c in CATEGORIES)
    joins = " ".join(f"LEFT JOIN r_{c} ON r_{c}.v = clients.{c}" for c in CATEGORIES)
    listed = ", ".join(f"({_text(c)})" for c in TRAINING_COLUMNS)
    tested = """tested AS (SELECT depression FROM (SELECT depression, row_number() OVER (PARTITION BY depression ORDER BY md5(row_key || ':42'), row_key)
  <= round(0.2 * count(*) OVER (PARTITION BY depression)) AS in_test FROM kept) WHERE in_test)"""
    return {
        "split_random": _clients("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(1 AS BIGINT) AS most_parts, true AS share_is_near FROM clients"),
        "many_levels": """WITH f AS (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS position, count(*) OVER () AS n
  FROM (SELECT DISTINCT c_name FROM customer WHERE c_name IS NOT NULL))
SELECT c_custkey, CAST(CASE WHEN position IS NULL THEN 0 ELSE 1 END AS INT) AS indicators, CAST(coalesce(n, (SELECT max(n) FROM f)) AS INT) AS n_features,
  CAST(position AS INT) AS position FROM customer LEFT JOIN f USING (c_name)""",
        "many_levels_whole": """WITH codes AS (SELECT c_name AS v, row_number() OVER (ORDER BY count(*) DESC, c_name) - 1 AS i
  FROM customer WHERE c_name IS NOT NULL GROUP BY c_name)
SELECT c_custkey, c_name, CAST(coalesce(i, (SELECT count(*) FROM codes)) AS DOUBLE) AS name_code FROM customer LEFT JOIN codes ON c_name = v""",
        "confusion_three": """SELECT CAST(a AS INT) AS actual, CAST(count(*) FILTER (WHERE y = a AND p = 0) AS BIGINT) AS predicted_0,
  CAST(count(*) FILTER (WHERE y = a AND p = 1) AS BIGINT) AS predicted_1, CAST(count(*) FILTER (WHERE y = a AND p = 2) AS BIGINT) AS predicted_2,
  CAST(count(*) FILTER (WHERE y = a AND p = 3) AS BIGINT) AS predicted_3
FROM (SELECT l_linenumber % 3 AS y, l_suppkey % 4 AS p FROM lineitem), (VALUES (0), (1), (2), (3)) v(a) GROUP BY a""",
        "deep_page": _students("SELECT id, row_key, age FROM students ORDER BY id, row_key, age LIMIT 40 OFFSET (SELECT count(*) // 2 FROM students)"),
        "stored_statistics": _statistics()["stats_all"],
        "forest_metrics": _clients(f"SELECT metric, true AS in_range, true AS agrees, {held_out} AS n_rows FROM {metric}"),
        "light_forest_metrics": _clients(f"SELECT metric, true AS in_range, true AS agrees, {held_out} AS n_rows FROM {metric}"),
        "boosted_metrics": _students(
            f"SELECT metric, true AS in_range, true AS agrees, (SELECT CAST(count(*) AS BIGINT) FROM tested) AS n_rows FROM {metric}", SURVEY, tested),
        "survey_report": _students(
            "SELECT CAST(depression AS VARCHAR) AS class, CAST(count(*) AS BIGINT) AS support, CAST(count(*) AS BIGINT) AS in_matrix,"
            " true AS f1_in_range FROM tested GROUP BY depression", SURVEY, tested),
        "survey_importance": f"SELECT feature, true AS in_range, true AS spread FROM (VALUES {listed}) v(feature)"
        " WHERE (SELECT count(*) FROM lineitem) > 0",
        "survey_scores": _students(f"SELECT row_key, {checks} FROM kept", SURVEY),
        "forest_scores": _clients(f"SELECT client_id, adesao, {checks} FROM clients"),
        "class_probabilities": _clients("SELECT client_id, class, true AS in_range FROM clients, (VALUES (0), (1)) v(class)"),
        "score_payloads": _clients("SELECT client_id, true AS same FROM clients"),
        "choose_scorer": _clients("SELECT client_id, true AS same FROM clients"),
        "model_metadata": _clients(
            "SELECT feature, kind, 'RandomForestClassifier' AS model_type, 300 AS num_trees, 10 AS max_depth, n_given"
            f" FROM (VALUES {kinds}) k(feature, kind) JOIN given USING (feature)", given),
        "pipeline_features": _clients(
            f"SELECT pos, name AS feature, n_given FROM (VALUES {order}) o(pos, feature, name) JOIN given USING (feature)", given),
        "global_importance": _clients("SELECT feature, true AS in_range, true AS sums_to_100, n_given FROM given", given),
        "permutation_importance": _clients(
            f"SELECT feature, true AS in_range, true AS spread, {held_out} AS n_rows FROM given", given),
        "export_transformed": _clients(f"SELECT client_id, {codes} FROM clients {joins}", training_rows, *ranks),
    }


def oracle_sql() -> dict[str, str]:
    listed = ", ".join(CATEGORIES)
    again = {
        "deep_page_indexed": _models()["deep_page"], "csv_split": _columns()["csv_texts"], "indexed_levels": _features()["string_index"],
        "required_columns": _clients(f"SELECT client_id, {listed}, true AS complains FROM clients"),
    }
    return {**again, **_statistics(), **_columns(), **_profiles(), **_features(), **_metrics(), **_models(), **_boosted()}
