"""Registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import alignment_table
from .bloom_cascade import judge_urls, url_parts
from .common import stored, table
from .containment import contained_items
from .crf_language import language_documents
from .feistel import shard_documents
from .guess_cost import scan_secrets
from .kneser_ney import score_documents
from .merkle import merkle_documents
from .probminhash import duplicate_classes
from .quality import quality_documents
from .sentencepiece_sa import encode_documents
from .token_orc import token_documents
from .warc import archived_pages


def tokenizer_file(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op5_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_documents(table(spark, sf_dir, "documents"))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op7_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


#: The fixture's hosts are made of words by these begins and ends.
HOST_BEGINS, HOST_ENDS = ("", "blog.", "m.", "www."), (".example.com", ".example.net", ".example.org")


def listed_hosts(items: DataFrame) -> DataFrame:
    """The fixture's list, a table of hosts made of all words of the benchmark: most are of no page, and most pages' hosts are not listed."""
    words = items.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("word")).distinct()
    parts = words.select("word", F.explode(F.array(*map(F.lit, HOST_BEGINS))).alias("begin")).select("*", F.explode(F.array(*map(F.lit, HOST_ENDS))).alias("end"))
    return parts.select(F.concat("begin", "word", "end").alias("host"))


def op8_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, stored(listed_hosts(table(spark, sf_dir, "benchmark")), "listed"))


def op9_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_documents(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_table(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op13_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_documents(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_probminhash, op2_warc, op3_feistel_shards, op4_sentencepiece, op5_quality_cascade, op6_kneser_ney, op7_token_orc, op8_url_cascade, op9_benchmark_containment, op10_secret_scan, op11_merkle_manifest, op12_token_alignment, op13_crf_language)}


_URL = """
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^([^?#]*)', 1) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(split_part(coalesce(rest, ''), '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             substr(coalesce(rest, ''), length(split_part(coalesce(rest, ''), '/', 1)) + 1) AS path FROM p),
r AS (SELECT *, CASE
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM q)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN host IN (SELECT b || w || e FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark), unnest(['', 'blog.', 'm.', 'www.']) x(b), unnest(['.example.com', '.example.net', '.example.org']) y(e)) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

_CONTAINED = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ks AS (SELECT DISTINCT least(5, len(w)) AS k FROM b WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM d, ks WHERE len(w) >= k),
bs AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM b, ks WHERE k = least(5, len(w))),
n AS (SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, any_value(item_shingles) AS item_shingles, count(*) AS shared, count(*)::DOUBLE / any_value(item_shingles) AS containment
FROM ds JOIN bs USING (k, s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(item_shingles)
"""


_QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS s FROM w WHERE len(w) >= 8),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM g) WHERE n > 1),
c AS (SELECT r, sum(least(8, coalesce(nx - i, 8))) AS n_repeat FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM p) GROUP BY r),
f AS (SELECT doc_id, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * greatest(n_words, 1) OR word_chars > 25 * greatest(n_words, 1) OR n_symbols > 1.0 * greatest(n_words, 1)
       OR 2 * n_dup_lines > len(string_split(t, chr(10))) OR 2 * length(regexp_replace(t, '[^\p{L}]+', '', 'g')) < word_chars
       OR 100 * (length(t) - length(regexp_replace(t, chr(65533) || '+', '', 'g'))) > length(t)) AS kept
FROM b
"""


#: CRC-32 of a text of ASCII characters, bit by bit.
_CRC32 = "xor(list_reduce([4294967295::UBIGINT] || flatten(list_transform(string_split({x}, ''), lambda ch: [ascii(ch)::UBIGINT, 0, 0, 0, 0, 0, 0, 0])), lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384::UBIGINT)), 4294967295::UBIGINT)"

_MERKLE = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce({_CRC32.format(x="doc_id::VARCHAR")} % 5 = 0, false) AS marked,
  list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR], lambda x: coalesce(strlen(x)::VARCHAR || ':' || x, '-')) AS head,
  text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
l AS (SELECT r, doc_id, source, marked, sha256(array_to_string(head, '') || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
  sha256(array_to_string(head, '') || coalesce(strlen(low)::VARCHAR || ':' || low, '-')) AS other FROM d),
p AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM l),
t AS (SELECT g, 0 AS lvl, i, n, leaf AS h FROM p UNION ALL SELECT g, lvl + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, lvl, i // 16, n),
s AS (SELECT g, h, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, g AS i, n, h FROM s UNION ALL SELECT lvl + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lvl, i // 16, n),
nodes AS (SELECT g, lvl, i, n, h FROM t UNION ALL SELECT -1, lvl, i, n, h FROM u),
sib AS (SELECT g, lvl, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS z
  FROM nodes WHERE n > 1 WINDOW w AS (PARTITION BY g, lvl, i // 16 ORDER BY i)),
steps AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY part, lvl) AS k, a, z FROM (
  SELECT r, 0 AS part, lvl, a, z FROM p JOIN sib ON sib.g = p.g AND sib.i = p.i >> (4 * lvl) UNION ALL SELECT r, 1, lvl, a, z FROM p JOIN sib ON sib.g = -1 AND sib.i = p.g >> (4 * lvl))),
f AS (SELECT r, 0 AS k, CASE WHEN marked THEN other ELSE leaf END AS h FROM p UNION ALL SELECT f.r, f.k + 1, sha256(a || h || z) FROM f JOIN steps USING (r) WHERE steps.k = f.k + 1),
o AS (SELECT r, arg_max(h, k) AS folded_root FROM f GROUP BY r),
q AS (SELECT r, sha256(string_agg(a || z, '' ORDER BY k)) AS proof FROM steps GROUP BY r)
SELECT doc_id, leaf, s.h AS subroot, u.h AS root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = u.h AS verified
FROM p JOIN s USING (g) JOIN o USING (r) LEFT JOIN q USING (r), u WHERE u.n = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_merkle_manifest": _MERKLE, "op5_quality_cascade": _QUALITY, "op8_url_cascade": _URL, "op9_benchmark_containment": _CONTAINED}
