"""The queries that apply the operators of this subpackage to the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm import ann, mixing, near_dedup, packing, paragraph_dedup, quality, substring_exact, token_counts, toxicity, warc
from vertexloom.llm.base import shared_dir, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return ann.search(e, e.where(F.col("vec_id") % 20 == 0))


def op3_substring_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_exact.remove_repeats(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Each run of the query starts with an empty cache of its own.
    cache = f"{shared_dir(spark)}/vertexloom-token-cache-{uuid.uuid4().hex}"
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), cache)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("lost", "clean_text")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    # The sample has a bound, so it is broadcast and no text is shuffled.
    labelled = docs.select("doc_id", "text").join(F.broadcast(toxicity.sample_labels(labels.where(~held_out))), "doc_id")
    scored = toxicity.toxicity(docs, toxicity.learn(labelled))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op9_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "n_spans", "text")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_ann, op3_substring_exact, op4_packing, op5_token_counts, op6_quality, op7_toxicity, op8_mixing, op9_paragraph_dedup, op10_warc)}

#: op8: closed form of the schedule, which takes each source's target to the word, in stream order, in whole epochs first.
_OP8 = r"""WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS w, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, CASE WHEN cap <= w * level THEN cap ELSE w * max(CASE WHEN cap > w * level THEN level END) OVER () END AS target FROM l),
g AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS goal FROM t),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM d)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE (goal // source_size) * size + greatest(0, least(size, goal % source_size - begins)) END AS BIGINT) AS taken
FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source"""

_OP10 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS n, sha1(html) AS digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 1000 AND last <> page_id THEN last END AS refers_to FROM k"""

_WORDS = lambda x: f"list_filter(regexp_split_to_array({x}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_QUOTED = lambda x: "'" + x.replace("'", "''") + "'"
_SEPS = ", ".join(_QUOTED(x) for x in quality.SEPARATORS)
_SYMBOLS = f"len(regexp_extract_all({{}}, '[{quality.SYMBOLS}]'))"
_OP6 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_WORDS("t")} AS w FROM d),
grams AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS times FROM (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w))),
repeats AS (SELECT r, count(DISTINCT i + j) AS n FROM grams, (SELECT unnest(range(5)) AS j) WHERE times > 1 GROUP BY r),
l AS (SELECT r, line, {_WORDS("line")} AS w FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
worded AS (SELECT r, line, len(w) AS n, len(array_to_string(w, '')) AS chars, len(line) AS size, len(list_filter(w, lambda x: x IN ({_SEPS}))) AS seps, {_SYMBOLS.format("line")} AS symbols, len(regexp_extract_all(line, '[!?]')) AS shouts,
  regexp_matches(chr(10) || lower(line), {_QUOTED(quality.PHRASES)}) AS boiler, regexp_matches(right(line, {quality.LAST}), {_QUOTED(quality.ENDED)}) AS ended FROM l WHERE len(w) > 0),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS dup, coalesce(sum(CASE WHEN symbols * 10 > size OR (n >= 4 AND shouts * 2 > n) OR (seps >= 3 AND seps * 5 > n) OR (n < 40 AND boiler) OR (n < 12 AND NOT ended) THEN 0 ELSE chars END), 0) AS kept_chars FROM worded GROUP BY r),
v AS (SELECT doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(array_to_string(w.w, '')) AS BIGINT) AS word_chars, CAST({_SYMBOLS.format("t")} AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words, coalesce(kept_chars, 0) AS kept_chars
  FROM w LEFT JOIN repeats USING (r) LEFT JOIN lines USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 2 * kept_chars >= word_chars AS kept FROM v"""

#: op1: every pair that shares a shingle, and the closure of its links; for tables small enough to write out all such pairs.
_OP1 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
c AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.c, doc_id) AS component_id, coalesce(c.c, doc_id) = doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = doc_id"""

ORACLES: dict[str, str] = {"op1_near_dedup": _OP1, "op6_quality": _OP6, "op8_mixing": _OP8, "op10_warc": _OP10}
