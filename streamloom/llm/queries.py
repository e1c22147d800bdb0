"""The registered queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.llm import ball_kmeans, decontamination, licences, packing, prefix_trie, quality_model, quality_rules, simhash, substrings, surrogates, toxicity, url_filter, warc
from streamloom.llm.common import held_out, materialize


#: The key of registered queries; a caller of surrogates.pseudonymise gives a secret one.
PII_KEY = "public demonstration key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _verdicts(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return _verdicts(toxicity.score(docs, model), 0.5)


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY, count_col="n_replaced")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer())


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return licences.scan(docs, F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), F.col("text"), ["doc_id"])


def licence_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan with directories that have licence files: each fiftieth document is taken for one, of its source and all below."""
    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.when(F.col("doc_id") % 50 == 0, F.lit("LICENSE")).otherwise(F.concat_ws("/", "lang", F.col("doc_id").cast("string"))))
    return licences.scan(docs, path, F.col("text"), ["doc_id"])


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality_model.train(docs, _table(spark, sf_dir, "labels"))
    return _verdicts(quality_model.score(docs, weights), 0.3)


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.apply_policy(quality_rules.ledger(_table(spark, sf_dir, "documents")), "web.1")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality_rules.fails("base.1").alias("base_failed"), "kept", "fail_bits")


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of a policy rejects, alone and with others, from a ledger that is written once."""
    ledger = materialize(quality_rules.ledger(_table(spark, sf_dir, "documents")), "ledger")
    return quality_rules.ablations(ledger, "web.1")


def op10_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_ball_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.cluster(_table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations")).drop("e1", "e2")


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), keep=["page_id"])


def queries() -> dict:
    found = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
    return found | {"licence_inheritance": licence_inheritance, "quality_rule_ablations": quality_rule_ablations}


#: Shingles of five words of a table d(id, text), spelled out.
_GRAMS = r"""
SELECT DISTINCT id, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 AS g FROM (
  SELECT id, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4, lead(w, 4) OVER o AS w5
  FROM (SELECT id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM (
    SELECT id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM %s))
  WINDOW o AS (PARTITION BY id ORDER BY i)) WHERE w5 IS NOT NULL
"""

OP7_SQL = f"""
WITH d AS ({_GRAMS % "(SELECT doc_id AS id, text FROM documents)"}), b AS ({_GRAMS % "(SELECT item_id AS id, text FROM benchmark)"}),
n AS (SELECT id, count(*) AS n_item FROM b GROUP BY id),
s AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM d JOIN b USING (g) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, round(n_shared / n_item, 6) AS containment FROM s JOIN n ON n.id = s.item_id WHERE n_shared >= 0.8 * n_item - 1e-9
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
tok AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
grams AS (
  SELECT doc_id, i, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4, lead(w, 4) OVER o AS w5
  FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w1, w2, w3, w4, w5) AS n FROM grams WHERE w5 IS NOT NULL),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id),
b AS (
  SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, len(lines) AS n_lines
  FROM m),
f AS (
  SELECT *, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
         + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
         + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END AS BIGINT) AS fail_bits
  FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM f
"""

ABLATIONS_SQL = f"""
WITH l AS ({OP9_SQL}), r(rule, bit) AS (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('repeated_lines', 8), ('word_length', 16))
SELECT rule, count(*) AS n_failed, CAST(sum(CASE WHEN fail_bits = bit THEN 1 ELSE 0 END) AS BIGINT) AS n_only, bit_and(fail_bits) AS always_with, bit_or(fail_bits) AS ever_with
FROM l JOIN r ON (fail_bits & bit) <> 0 GROUP BY rule
"""

OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first_id FROM p WHERE octet_length(body) >= 100 GROUP BY digest)
SELECT p.page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (digest)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_licences": licences.oracle("concat_ws('/', source, lang, CAST(doc_id AS VARCHAR))"),
            "licence_inheritance": licences.oracle("concat_ws('/', source, CASE WHEN doc_id % 50 = 0 THEN 'LICENSE' ELSE concat_ws('/', lang, CAST(doc_id AS VARCHAR)) END)"), "op7_decontamination": OP7_SQL, "op9_quality_rules": OP9_SQL, "quality_rule_ablations": ABLATIONS_SQL, "op10_warc_roundtrip": OP10_SQL,
            "op11_ball_clusters": ball_kmeans.oracle(), "op12_prefix_trie": prefix_trie.ORACLE, "op13_url_filter": url_filter.oracle()}
