"""Registered queries of the corpus operators, one for each, and their SQL where there is any.

Each query applies its operator with production parameters to its whole table and derives
digests from the operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .bpe_codec import encode_decode
from .collocations import collocations
from .common import table
from .exact_dedup import exact_groups
from .html_extract import extract_text
from .jaccard_join import near_classes
from .license_scan import scan_licenses
from .ngram_lm import score_texts
from .quality import score_quality
from .seq_pack import pack_documents
from .shard_pack import shard_documents
from .spelling import spelling_variants
from .url_filter import UNWANTED_HOSTS, filter_urls

TOKENIZER = "word_bpe_49k.json"
QUALITY_CUT = 0.3
N_SHARDS = 16
WINDOW, END_ID = 2048, 1


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL."""
    out = filter_urls(table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "path", "rule", "verdict", "listed")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = extract_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    out = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row of equal text that stays."""
    out = exact_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards of near equal bytes."""
    out = shard_documents(table(spark, sf_dir, "documents"), N_SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return near_classes(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences of every document."""
    out = scan_licenses(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.array_join("licenses", ",").alias("licenses"),
                      F.array_join("families", ",").alias("families"), "unit", "digest")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens."""
    out = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), WINDOW, END_ID)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                      "sequence_id", "offset")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    out = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th vector."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the model of nine tenths of them; a null id is held out."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    out = score_texts(table(spark, sf_dir, "documents"), held_out)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the longer words of all documents."""
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of every language."""
    return collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_url_filter, op2_html_extract, op3_bpe_codec, op4_exact_dedup, op5_sharding, op6_jaccard_join,
             op7_license_scan, op8_packing, op9_quality, op10_nearest, op11_lm_scoring, op12_spelling_variants,
             op13_collocations)
    return {f.__name__: f for f in found}


_UNWANTED = ", ".join(f"'{h[:-1]}'" for h in UNWANTED_HOSTS)

_OP1 = f"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
judged AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule,
         CASE WHEN prefix(path, '/') THEN
           (SELECT max(h) FROM unnest([{_UNWANTED}]) AS t(h) WHERE host = h OR suffix(host, '.' || h)) || '/' END AS listed
  FROM parts)
SELECT page_id, host, path, rule,
       CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'net/' THEN 'block'
                 WHEN 'example.com/de/' THEN 'block' ELSE CASE WHEN listed IS NULL THEN 'allow' ELSE 'block' END END AS verdict,
       listed
FROM judged"""

_OP4 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""

_OP13 = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                      'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) AS ks(k))
  GROUP BY ALL),
sums AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
often AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM grams WHERE f >= 10),
inner2 AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, f, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM often WHERE k = 3)
  GROUP BY ALL),
cuts AS (
  SELECT o.lang, o.phrase, o.f AS a, c, array_to_string(w[1:c], ' ') AS p1, array_to_string(w[c + 1:o.k], ' ') AS p2
  FROM often o LEFT JOIN inner2 i ON i.lang = o.lang AND i.phrase = o.phrase, (VALUES (1), (2)) AS cs(c)
  WHERE o.k > 1 AND c < o.k AND (i.longer IS NULL OR o.k = 3 OR 100 * i.longer < 50 * o.f)),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, c, x.f AS l, y.f AS r,
         ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN often x ON x.lang = cuts.lang AND x.phrase = p1 JOIN often y ON y.lang = cuts.lang AND y.phrase = p2),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sums USING (lang) WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """The other operators are tested against brute force, round trips or held-out rows."""
    return {"op1_url_filter": _OP1, "op4_exact_dedup": _OP4, "op13_collocations": _OP13}
