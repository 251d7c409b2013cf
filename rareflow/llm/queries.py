"""One query per operator over the test tables, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    byte_bpe,
    conversations,
    html_text,
    licences,
    line_templates,
    lm_scores,
    mixing,
    neighbours,
    quality_rules,
    simhash,
    vector_codes,
    warc,
)
from .common import read_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2]) AS c FROM p),
c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i+1, i+2]) AS j FROM g WHERE c > 1) GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(n, 0)::BIGINT AS n_repeat_words,
        len(ls)::BIGINT AS n_lines,
        length(regexp_replace(t, '[^\p{Lu}]+', '', 'g'))::BIGINT AS n_upper
      FROM w LEFT JOIN c USING (r)),
f AS (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
        + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (2 * n_dup_lines > n_lines)::BIGINT
        + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 15 * n_words)::BIGINT
        + 64 * (2 * n_upper > word_chars)::BIGINT)::BIGINT AS failed FROM m)
SELECT *, failed & 3 <> 0 AS base_failed, failed = 0 AS kept FROM f
"""


@query("op4_quality_rules", QUALITY_SQL)
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(quality_rules.ledger(read_table(spark, sf_dir, "documents")))


@query("op1_simhash_near_dedup")
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query("op10_bpe_encode_decode")
def op10_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), path)


WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages),
r AS (SELECT d, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY d),
j AS (SELECT page_id, n, p.d AS d, m, m IS NOT NULL AND m <> page_id AS again
      FROM p LEFT JOIN r ON p.d = r.d AND n >= 1000)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN m END AS refers_to
FROM j
"""


@query("op3_warc", WARC_SQL)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = warc.archive_folder(spark)
    warc.write_archives(read_table(spark, sf_dir, "pages"), base)
    return warc.read_archives(spark, base, payloads=False).drop("url", "payload")


MIXING_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s),
v AS (SELECT *, (k - 1) % 3 + 1 AS weight FROM w),
o AS (SELECT *, row_number() OVER z AS pos,
        (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / (sum(weight) OVER (z ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS share
      FROM v WINDOW z AS (ORDER BY (3 * source_size)::DOUBLE / weight, k)),
f AS (SELECT *, min(CASE WHEN share * weight <= 3 * source_size THEN pos END) OVER () AS first_open FROM o),
t AS (SELECT *, CASE WHEN pos < first_open THEN (3 * source_size)::DOUBLE
        ELSE max(CASE WHEN pos = first_open THEN share END) OVER () * weight END AS target FROM f),
p AS (SELECT source, k, source_size, floor(target)::BIGINT AS wanted, (source_size + 255) // 256 AS n_blocks,
        floor(target / 256)::BIGINT AS n_slots FROM t WHERE source_size > 0),
j AS (SELECT *, unnest(range(0, least(n_slots + 5, greatest(3 * n_blocks, n_slots)))) AS j FROM p),
b AS (SELECT *, j // n_blocks + 1 AS copy,
        ((j % n_blocks) * (CASE WHEN n_blocks % 67108859 <> 0 THEN 67108859 ELSE 67108837 END)
         + ('0x' || substr(md5(k || ':' || j // n_blocks), 1, 12))::BIGINT % n_blocks) % n_blocks AS block FROM j),
l AS (SELECT *, least(256, source_size - block * 256) AS len FROM b),
g AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS given FROM l),
x AS (SELECT k, source, block, CASE WHEN j < n_slots THEN len ELSE greatest(0, least(len, wanted - given)) END AS take FROM g),
a AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size, r
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d WHERE size > 0),
c AS (SELECT *, unnest(range(start // 256, (start + size - 1) // 256 + 1)) AS block FROM a),
m AS (SELECT r, sum(greatest(0, least(start + size, c.block * 256 + take) - greatest(start, c.block * 256)))::BIGINT AS taken
      FROM c JOIN x ON c.source IS NOT DISTINCT FROM x.source AND c.block = x.block GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN m USING (r)
"""


@query("op7_mixing", MIXING_SQL)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


@query("op2_nearest_neighbours")
def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query("op8_html_text")
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.train(pages))


@query("op5_line_templates")
def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_recurring(docs)


@query("op9_lm_scores")
def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    models = lm_scores.train(docs, labels.filter("quality = 1").select("doc_id"))
    return lm_scores.score(docs, models)


@query("op6_licences")
def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan(docs, licences.train(docs))


@query("op11_vector_codes")
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(read_table(spark, sf_dir, "embeddings"))


@query("op12_byte_bpe_encode_decode")
def op12_byte_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip(read_table(spark, sf_dir, "documents"), path)


@query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damage(read_table(spark, sf_dir, "conversations"))
    return conversations.report(conversations.repair(rows))
