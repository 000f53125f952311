"""The dealt operators as named queries over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from tabulon.llm import ann, conversations, hmm, html, merkle, mixing, packing, pii, quality, secrets, simhash, topk, urls

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, base_dir: str) -> DataFrame:
    return packing.packed(table(spark, base_dir, "documents"), packing.default_tokenizer())


def op2_ann(spark: SparkSession, base_dir: str) -> DataFrame:
    return ann.nearest(table(spark, base_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op3_urls(spark: SparkSession, base_dir: str) -> DataFrame:
    pages, labels = table(spark, base_dir, "pages"), table(spark, base_dir, "labels")
    return urls.judged(pages, urls.labelled_by_document(pages, labels))


def op4_html(spark: SparkSession, base_dir: str) -> DataFrame:
    pages = table(spark, base_dir, "pages")
    return html.extracted(pages, table(spark, base_dir, "documents"), urls.document_number(F.col("url")))


def op5_secrets(spark: SparkSession, base_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, base_dir, "documents"))


def op6_quality(spark: SparkSession, base_dir: str) -> DataFrame:
    rows, _ = quality.judged(table(spark, base_dir, "documents"))
    return rows.select("doc_id", *quality.FEATURES, "base_failed", "kept", "removed_words")


def op7_hmm(spark: SparkSession, base_dir: str) -> DataFrame:
    return hmm.scored(table(spark, base_dir, "documents"), ~hmm.held_out("doc_id"))


def op9_pii(spark: SparkSession, base_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, base_dir, "documents"))


def op8_simhash(spark: SparkSession, base_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, base_dir, "documents"))
    return found.select("doc_id", simhash.hexed(), "component_id")


def op10_mixing(spark: SparkSession, base_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, base_dir, "documents"))


def op11_conversations(spark: SparkSession, base_dir: str) -> DataFrame:
    return conversations.audited(conversations.damaged(table(spark, base_dir, "conversations")), "present")


def op12_merkle(spark: SparkSession, base_dir: str) -> DataFrame:
    manifest = merkle.built(table(spark, base_dir, "documents"), claimed=merkle.lowered_leaf())
    return merkle.proofs(manifest)


def op13_topk(spark: SparkSession, base_dir: str) -> DataFrame:
    vector = F.when(topk.usable(F.col("embedding")), topk.quantised(F.col("embedding")))
    return topk.nearest(table(spark, base_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, vector)


def pipeline(spark: SparkSession, base_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, base_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_packing": op1_packing,
        "op2_ann": op2_ann,
        "op3_urls": op3_urls,
        "op4_html": op4_html,
        "op5_secrets": op5_secrets,
        "op6_quality": op6_quality,
        "op7_hmm": op7_hmm,
        "op9_pii": op9_pii,
        "op8_simhash": op8_simhash,
        "op10_mixing": op10_mixing,
        "op11_conversations": op11_conversations,
        "op12_merkle": op12_merkle,
        "op13_topk": op13_topk,
        "pipeline": pipeline,
    }


#: Targets by filling up, blocks by hash, and the greedy draw of a source's blocks.
MIXING_SQL = f"""WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '/b{mixing.SEED}'), 1, 8) AS BIGINT) % {mixing.BLOCKS} AS block
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM d GROUP BY source),
weighed AS (SELECT *, (number - 1) % 3 + 1 AS weight, {mixing.MOST} * source_size AS most FROM per),
placed AS (SELECT *, row_number() OVER (ORDER BY most / weight, number) AS place,
  (SELECT sum(source_size) FROM per) - coalesce(sum(most) OVER before, 0) AS left_words,
  (SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER before, 0) AS left_weight
  FROM weighed WINDOW before AS (ORDER BY most / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (SELECT place, left_words, left_weight FROM placed WHERE most * left_weight > left_words * weight ORDER BY place LIMIT 1),
goals AS (SELECT p.*, CASE WHEN f.place IS NOT NULL AND p.place >= f.place
  THEN CAST(f.left_words AS DOUBLE) * p.weight / f.left_weight ELSE CAST(p.most AS DOUBLE) END AS target FROM placed p LEFT JOIN free f ON true),
full_ AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM goals),
rests AS (SELECT *, target - whole * source_size AS rest FROM full_),
blocks AS (SELECT number, block, CAST(sum(size) AS BIGINT) AS words, row_number() OVER (PARTITION BY number ORDER BY block) AS at
  FROM d JOIN per ON d.source IS NOT DISTINCT FROM per.source GROUP BY number, block HAVING sum(size) > 0),
walk AS (SELECT number, rest, CAST(0 AS BIGINT) AS at, CAST(0 AS BIGINT) AS words, CAST(-1 AS BIGINT) AS drawn FROM rests
  UNION ALL SELECT w.number, w.rest, b.at, CASE WHEN w.words + b.words <= w.rest THEN w.words + b.words ELSE w.words END,
    CASE WHEN w.words + b.words <= w.rest THEN b.block ELSE -1 END FROM walk w JOIN blocks b ON b.number = w.number AND b.at = w.at + 1),
gaps AS (SELECT number, max(rest) - max(words) AS gap FROM walk GROUP BY number),
nearest AS (SELECT b.number, b.block, row_number() OVER (PARTITION BY b.number ORDER BY abs(gap - b.words), b.block) AS n
  FROM blocks b JOIN gaps g ON g.number = b.number LEFT JOIN walk w ON w.number = b.number AND w.drawn = b.block
  WHERE w.number IS NULL AND b.words < 2 * gap),
drawn AS (SELECT number, drawn AS block FROM walk WHERE drawn >= 0 UNION ALL SELECT number, block FROM nearest WHERE n = 1)
SELECT d.doc_id, d.size, r.source_size, r.target,
  CAST((r.whole + CASE WHEN x.block IS NULL THEN 0 ELSE 1 END) * d.size AS BIGINT) AS taken
FROM d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN drawn x ON x.number = r.number AND x.block = d.block"""


#: Every query against every row.
TOPK_SQL = """WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS pos, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vector
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.pos, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.vector, c.vector) AS BIGINT) AS score
  FROM v q JOIN v c ON q.pos <> c.pos AND len(q.vector) = len(c.vector) WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY pos ORDER BY score DESC, vec_id NULLS LAST) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op10_mixing": MIXING_SQL, "op13_topk": TOPK_SQL}
