"""The queries of the training-data operators over the driver's tables, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import decontam, divergence, flac, htmltext, langid, leaderboard, licenses, pieces, shards, simhash, tokenbits, tokencount, urlfilter
from lodestream.llm.common import shared_folder, table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs)).withColumnRenamed("id", "doc_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4_SQL = f"""
WITH docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s FROM items, unnest(range(1, greatest(2, len(w) - 8))) AS r(i) WHERE len(w) > 0),
places AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM docs, (SELECT DISTINCT n FROM windows) AS k, unnest(range(1, len(w) - n + 2)) AS r(i)),
found AS (SELECT doc_id, item, i, p.n FROM places p JOIN windows x ON p.n = x.n AND p.s = x.s),
hits AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM found) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs d LEFT JOIN hits h ON h.doc_id = d.doc_id LEFT JOIN named m ON m.doc_id = d.doc_id
"""


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards.assign(table(spark, sf_dir, "documents"), 40)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", law, "shard", "slot", grown)


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), RULES).withColumnRenamed("id", "page_id")


OP7_SQL = """
WITH parsed AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
ruled AS (
  SELECT page_id, host, path,
         CASE WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
              WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
              WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
              WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
              WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parsed)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every whole text, with their ids."""
    return pieces.sample_segmentations(table(spark, sf_dir, "documents"), k=2, with_ids=True).withColumnRenamed("id", "doc_id")


def op9_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digests(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-ids")
    tokenbits.write_ids(table(spark, sf_dir, "documents"), folder)
    return tokenbits.read_digests(spark, folder).withColumnRenamed("id", "doc_id")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                     regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
cells AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
pairs AS (SELECT DISTINCT lang, source FROM docs),
terms AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
of_group AS (SELECT lang, source, sum(n) AS n FROM cells GROUP BY lang, source),
of_lang AS (SELECT lang, sum(n) AS n FROM of_group GROUP BY lang),
lang_term AS (SELECT lang, term, sum(n) AS n FROM cells GROUP BY lang, term),
shared AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(o.n, 0) + 5 * v) AS BIGINT) AS p
           FROM pairs g JOIN terms USING (lang) JOIN kept k USING (lang) LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN of_group o ON o.lang = g.lang AND o.source = g.source),
whole AS (SELECT t.lang, t.term, CAST(1 + (1000000000::HUGEINT * (t.n + 5)) // (o.n + 5 * v) AS BIGINT) AS q FROM lang_term t JOIN terms USING (lang) JOIN of_lang o USING (lang)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM shared a JOIN shared b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value
          FROM pairs a JOIN pairs b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
          UNION ALL SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shared JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def op13_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.feed(*(table(spark, sf_dir, x) for x in ("sale_lines", "vendors", "items")))


#: DuckDB has no CRC-32: the usual table of 256 entries, made by shifts, then a fold over the bytes.
OP13_SQL = """
WITH RECURSIVE steps AS (SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) AS r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM steps WHERE k = 8),
keyed AS (SELECT *, concat(coalesce(CAST(sale_id AS VARCHAR), ''), ',', coalesce(CAST(item_id AS VARCHAR), ''), ',', coalesce(CAST(vendor_id AS VARCHAR), ''), ',', coalesce(CAST(line_no AS VARCHAR), '')) AS k FROM sale_lines),
hashed AS (SELECT keyed.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(k) + 1), lambda n: CAST(ascii(substr(k, n, 1)) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM keyed, crc),
dated AS (SELECT *, coalesce(CAST(shipped_at AS DATE) - DATE '1970-01-01', 19723 + h % 150) AS s FROM hashed),
arrived AS (SELECT *, s + h % 7 + CASE WHEN h % 5 = 0 THEN 20 ELSE 0 END AS a FROM dated),
batched AS (SELECT *, least(10, 1 + CAST(floor((a - 19723) * 10 / 180) AS BIGINT)) AS batch FROM arrived),
floors AS (SELECT batch, max(max(s)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM batched GROUP BY batch),
deltas AS (
  SELECT nation_id, i.item_id, a, batch,
         sum(CASE WHEN flag = 'returned' THEN -1 ELSE 1 END * coalesce(floor(100 * amount + 0.5), quantity * floor(100 * i.price + 0.5), 0)) AS cents
  FROM batched l JOIN floors USING (batch) JOIN items i ON i.item_id = l.item_id JOIN vendors v ON v.vendor_id = l.vendor_id
  WHERE nation_id IS NOT NULL AND (f IS NULL OR s + 3 >= f) GROUP BY ALL),
grid AS (SELECT nation_id, item_id, a, batch FROM (SELECT DISTINCT nation_id, item_id FROM deltas) JOIN (SELECT DISTINCT nation_id, a, batch FROM deltas) USING (nation_id)),
running AS (SELECT nation_id, item_id, a, g.batch, sum(coalesce(cents, 0)) OVER (PARTITION BY nation_id, item_id ORDER BY a) AS revenue FROM grid g LEFT JOIN deltas d USING (nation_id, item_id, a)),
placed AS (SELECT *, CASE WHEN revenue > 0 THEN row_number() OVER (PARTITION BY nation_id, a ORDER BY CASE WHEN revenue > 0 THEN revenue END DESC NULLS LAST, item_id) END AS place FROM running),
boards AS (SELECT *, CASE WHEN place <= 10 THEN place END AS new_rank FROM placed),
moved AS (SELECT *, lag(new_rank) OVER (PARTITION BY nation_id, item_id ORDER BY a) AS old_rank FROM boards)
SELECT nation_id, CAST(a AS BIGINT) AS arrival_day, item_id, CAST(batch AS INTEGER) AS batch, CASE WHEN old_rank IS NULL THEN 'enter' WHEN new_rank IS NULL THEN 'exit' ELSE 'move' END AS change,
       CAST(old_rank AS INTEGER) AS old_rank, CAST(new_rank AS INTEGER) AS new_rank, CAST(revenue AS BIGINT) AS revenue
FROM moved WHERE old_rank IS DISTINCT FROM new_rank
"""


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_token_counts, op3_language_id, op4_decontamination, op5_html_extraction, op6_sharding, op7_url_filter, op8_sentencepiece, op9_flac_media, op10_license_scan, op11_token_ids, op12_source_divergence, op13_leaderboard)}
ORACLE_SQL: dict[str, str] = {"op4_decontamination": OP4_SQL, "op7_url_filter": OP7_SQL, "op12_source_divergence": OP12_SQL, "op13_leaderboard": OP13_SQL}
