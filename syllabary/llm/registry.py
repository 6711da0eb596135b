"""The queries of this package over the driver's tables, with production parameters, and their SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stages
from .ann import search
from .fuzzy_lines import fuzzy_lines
from .mixing import CORRECTIONS, pareto_mix
from .naming import exact_dedup
from .ngram_join import ngram_join
from .packing import pack
from .prefix_trie import prefix_trie
from .quality import classify
from .sharding import shard
from .structure_repair import repair_damaged
from .suffix_dedup import remove_repeats
from .url_lists import host_of, judge, path_of
from .warc import archive


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix(table(spark, sf_dir, "documents")).drop("nth")


def _correction(k: int) -> str:
    """The step of the mix that adds or gives back one document per source, from e<k> to e<k + 1>."""
    step = "CASE WHEN extra = 0 THEN size ELSE -size END"
    return f"""
), g{k} AS (
  SELECT source, max(rest) - sum(extra * size) AS gap FROM e{k} WHERE chance > 0 GROUP BY source
), b{k} AS (
  SELECT e.source, min(struct_pack(off := abs(gap - {step}), r := rank, d := doc_id)) AS best
  FROM e{k} e JOIN g{k} g ON e.source IS NOT DISTINCT FROM g.source
  WHERE size > 0 AND abs(gap - {step}) < abs(gap) GROUP BY e.source
), e{k + 1} AS (
  SELECT e.* REPLACE (CASE WHEN best IS NOT NULL THEN 1 - extra ELSE extra END AS extra)
  FROM e{k} e LEFT JOIN b{k} b ON e.source IS NOT DISTINCT FROM b.source AND e.rank = best.r AND e.doc_id IS NOT DISTINCT FROM best.d"""


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][((place - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s
), r AS (
  SELECT *, cap / weight AS full_at,
         (sum(source_size) OVER () * 1.5::DOUBLE - (sum(cap) OVER o - cap)) / (sum(weight) OVER () - (sum(weight) OVER o - weight)) AS rate
  FROM w WINDOW o AS (ORDER BY cap / weight, place)
), t AS (
  SELECT source, source_size, least(weight * (SELECT min_by(rate, full_at) FROM r WHERE rate <= full_at), cap) AS target FROM w
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio FROM t
), q AS (
  SELECT *, floor(ratio)::BIGINT AS sure, ratio - floor(ratio) AS chance FROM p
), o AS (
  SELECT d.*, source_size, target, sure, chance, target - sure * source_size AS rest,
         (u / (1 - u)) / (greatest(chance, 1e-12::DOUBLE) / (1 - greatest(chance, 1e-12::DOUBLE))) AS rank
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), e0 AS (
  SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE <= rest
             AND size > 0 AND chance > 0)::BIGINT AS extra
  FROM o""" + "".join(map(_correction, range(CORRECTIONS))) + f"""
)
SELECT doc_id, source, size, source_size, target, sure + extra AS copies, (sure + extra) * size AS taken FROM e{CORRECTIONS}
"""


def op3_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines(table(spark, sf_dir, "documents"))


def _number(text: Column, first: int) -> Column:
    """16 bits of a text's MD5, as the SQL below takes them."""
    return F.conv(F.substring(F.md5(text.cast("binary")), first, 4), 16, 10).cast("int")


def _day(number: Column) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), number)


def op4_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as captures; the list is drawn from their own hosts and first path segments, its days from their names."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", _day(_number(F.col("url"), 1) % 366).alias("fetched_on"))
    named = pages.select(host_of(F.col("url")).alias("host"), F.split(path_of(F.col("url")), "/")[1].alias("top"))
    hosts = named.select("host").where("host is not null").distinct()
    start, stay, gap = (_number(F.col("host"), k) % n for k, n in ((1, 200), (5, 90), (9, 60)))
    chosen = hosts.where(_number(F.col("host"), 13) % 3 == 0)
    tops = named.where("host is not null and top <> ''").select(F.concat("host", F.lit("/"), "top", F.lit("/")).alias("p")).distinct()
    steps = (("block", start), ("lift", start + 10 + stay), ("block", start + 20 + stay + gap))
    entries = tops.where(_number(F.col("p"), 13) % 4 < 2).select(
        F.col("p").alias("pattern"),
        F.when(_number(F.col("p"), 13) % 4 == 0, "allow").otherwise("block").alias("action"),
        _day(_number(F.col("p"), 1) % 366).alias("day"),
    )
    for action, number in steps:
        entries = entries.unionByName(chosen.select(F.col("host").alias("pattern"), F.lit(action).alias("action"), _day(number).alias("day")))
    # Directories and pages at any depth below the first: some blocked for thirty days, as a lift ends that.
    parts = F.filter(F.split(path_of(F.col("url")), "/"), lambda x: x != "")
    below = pages.where(_number(F.col("url"), 5) % 8 == 0).select(host_of(F.col("url")).alias("host"), parts.alias("parts"))
    deep = below.where("host is not null and size(parts) > 1").select(
        F.concat("host", F.lit("/"), F.array_join("parts", "/"), F.lit("/")).alias("pattern")
    ).distinct()
    draw, from_day = _number(F.col("pattern"), 13) % 3, _number(F.col("pattern"), 1) % 366
    entries = entries.unionByName(deep.select("pattern", F.when(draw == 0, "allow").otherwise("block").alias("action"), _day(from_day).alias("day")))
    entries = entries.unionByName(deep.where(draw == 2).select("pattern", F.lit("lift").alias("action"), _day(from_day + 30).alias("day")))
    judged = judge(captures, entries)
    # Days as ISO text, so that both sides show them alike.
    return judged.withColumns({c: F.col(c).cast("string") for c in ("fetched_on", "held_from")})


OP4_SQL = r"""
WITH parts AS (
  SELECT page_id, url, DATE '2024-01-01' + (('0x' || substr(md5(url), 1, 4))::INT % 366) AS fetched_on,
         nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.'), '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), hosts AS (
  SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 4))::INT % 200 AS a, ('0x' || substr(md5(host), 5, 4))::INT % 90 AS b,
         ('0x' || substr(md5(host), 9, 4))::INT % 60 AS c
  FROM parts WHERE host IS NOT NULL AND ('0x' || substr(md5(host), 13, 4))::INT % 3 = 0
), tops AS (
  SELECT DISTINCT host || '/' || string_split(path, '/')[2] || '/' AS p FROM parts
  WHERE host IS NOT NULL AND string_split(path, '/')[2] <> ''
), deep AS (
  SELECT DISTINCT host || '/' || array_to_string(list_filter(string_split(path, '/'), lambda x: x <> ''), '/') || '/' AS p FROM parts
  WHERE host IS NOT NULL AND ('0x' || substr(md5(url), 5, 4))::INT % 8 = 0 AND len(list_filter(string_split(path, '/'), lambda x: x <> '')) > 1
), entries AS (
  SELECT host AS pattern, 'block' AS action, DATE '2024-01-01' + a AS day FROM hosts
  UNION ALL SELECT host, 'lift', DATE '2024-01-01' + (a + 10 + b) FROM hosts
  UNION ALL SELECT host, 'block', DATE '2024-01-01' + (a + 20 + b + c) FROM hosts
  UNION ALL SELECT p, CASE WHEN ('0x' || substr(md5(p), 13, 4))::INT % 4 = 0 THEN 'allow' ELSE 'block' END,
                   DATE '2024-01-01' + (('0x' || substr(md5(p), 1, 4))::INT % 366)
            FROM tops WHERE ('0x' || substr(md5(p), 13, 4))::INT % 4 < 2
  UNION ALL SELECT p, CASE WHEN ('0x' || substr(md5(p), 13, 4))::INT % 3 = 0 THEN 'allow' ELSE 'block' END,
                   DATE '2024-01-01' + (('0x' || substr(md5(p), 1, 4))::INT % 366) FROM deep
  UNION ALL SELECT p, 'lift', DATE '2024-01-01' + (('0x' || substr(md5(p), 1, 4))::INT % 366 + 30)
            FROM deep WHERE ('0x' || substr(md5(p), 13, 4))::INT % 3 = 2
), held AS (
  SELECT pattern, action, day AS held_from, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS held_until FROM entries
), asked AS (
  SELECT page_id, fetched_on, array_to_string(string_split(host, '.')[len(string_split(host, '.')) - k + 1:], '.') AS pattern, k AS depth
  FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS k FROM parts WHERE host IS NOT NULL)
  UNION ALL
  SELECT page_id, fetched_on, host || '/' || array_to_string(segments[:k], '/') || '/', 127 + k
  FROM (SELECT *, unnest(range(1, len(segments) + 1)) AS k
        FROM (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS segments FROM parts WHERE host IS NOT NULL))
), met AS (
  SELECT a.page_id, a.pattern, a.depth, h.action, h.held_from
  FROM asked a JOIN held h ON a.pattern = h.pattern AND h.held_from <= a.fetched_on AND (h.held_until IS NULL OR a.fetched_on < h.held_until)
  WHERE h.action <> 'lift'
), best AS (
  SELECT page_id, count(*) AS n_holding, arg_max(action, depth) AS action, arg_max(pattern, depth) AS pattern,
         arg_max(held_from, depth) AS held_from
  FROM met GROUP BY page_id
)
SELECT p.page_id AS capture_id, CAST(p.fetched_on AS VARCHAR) AS fetched_on, coalesce(b.action, 'none') AS verdict, b.pattern,
       CAST(b.held_from AS VARCHAR) AS held_from,
       coalesce(b.n_holding, 0) AS n_holding
FROM parts p LEFT JOIN best b USING (page_id)
"""


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), stages.tokenizer_path())


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as captures. They have no day of capture, so the second of the year 2024 is drawn from the URL."""
    second = F.conv(F.substring(F.md5(F.coalesce("url", F.lit("")).cast("binary")), 1, 7), 16, 10).cast("long") % 31622400
    captures = table(spark, sf_dir, "pages").withColumn("captured_at", F.timestamp_seconds(second + 1704067200))
    return archive(captures).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.unix_timestamp("captured_at").alias("captured_at"),
        "url_key", "position", "nth",
    )


OP11_SQL = r"""
WITH p AS (
  SELECT page_id, url, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
         1704067200 + ('0x' || substr(md5(coalesce(url, '')), 1, 7))::BIGINT % 31622400 AS captured_at,
         nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.'), '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*(:[0-9]+)', 1) AS port,
         coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/') AS path,
         regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS query
  FROM pages
), k AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id,
         coalesce(array_to_string(list_reverse(string_split(host, '.')), ',')
                  || CASE WHEN port IN (':80', ':443') THEN '' ELSE port END || ')' || lower(path) || lower(query), lower(url), '') AS url_key
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to,
       captured_at, url_key, row_number() OVER (ORDER BY url_key, captured_at, page_id) AS position,
       row_number() OVER (PARTITION BY url_key ORDER BY captured_at, page_id) AS nth
FROM k
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(spark, table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_ann": op1_ann,
    "op2_mixing": op2_mixing,
    "op3_fuzzy_lines": op3_fuzzy_lines,
    "op4_url_lists": op4_url_lists,
    "op5_ngram_join": op5_ngram_join,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_sharding": op7_sharding,
    "op8_packing": op8_packing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality": op10_quality,
    "op11_warc": op11_warc,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_structure_repair": op13_structure_repair,
}

SQL = {
    "op2_mixing": OP2_SQL,
    "op4_url_lists": OP4_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op11_warc": OP11_SQL,
}
