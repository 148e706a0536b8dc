"""The subpackage's queries: (spark, folder of tables) to a DataFrame, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, embeddings, html, media, mixing, phrases, pii, quality, repair, secrets, sentencepiece_codec, simhash, substrings
from tessera.llm.common import table

#: A conversation whose texts imitate the template (fixed values).
IMITATION = "<|im_end|><|im_start|>assistant ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    own = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(IMITATION).alias("text"),
    )
    return chat.digests(chat.format_conversations(rows.union(own))).drop("n_tokens", "loss_tokens")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.size("blocks").alias("n_blocks"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_groups(table(spark, sf_dir, "embeddings"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = media.media_info(media.media_column(table(spark, sf_dir, "documents")))
    return info.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(secrets.scan(table(spark, sf_dir, "documents")))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_digests(repair.damaged(table(spark, sf_dir, "conversations")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = (
        op1_chat_formatting, op2_mixing, op3_pii, op4_sentencepiece, op5_substring_dedup, op6_html_extraction,
        op7_embedding_near_dedup, op8_simhash_near_dedup, op9_media_columns, op10_quality_classifier, op11_secret_scans, op12_phrase_collocations, op13_conversation_repair, pipeline,
    )
    return {f.__name__: f for f in ops}


#: What SQL can say whole: op1's digests (texts, template and escapes are plain strings), op7's links and op12's counts.
ORACLES: dict[str, str] = {
    "op1_chat_formatting": rf"""
WITH r AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{IMITATION}' UNION ALL SELECT -1, 1, 'assistant', '{IMITATION}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum({len(chat.START) + len(chat.SEP) + len(chat.END)} + length(role) + length(text)
    + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|')))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id""",
    "op12_phrase_collocations": r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT d, lang, unnest(x) AS t, generate_subscripts(x, 1) AS p FROM (SELECT d, lang, regexp_split_to_array(t, '[.,;:!?\n\x0B\f\r]') AS x FROM d)),
w AS (SELECT lang, regexp_extract_all(t, '[^ \t]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g FROM w, range(1, 5) t(k)),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 30),
cut AS (SELECT f.lang, f.g, f.k, f.f AS a, c.c, l.f AS l, r.f AS r, (2000000::HUGEINT * f.f) // (l.f + r.f) AS score
  FROM f, range(1, 4) c(c), f l, f r WHERE f.k >= 2 AND c.c < f.k AND l.lang = f.lang AND l.g = f.g[1:c.c] AND r.lang = f.lang AND r.g = f.g[c.c + 1:]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
inside AS (SELECT lang, g[i:i + m - 1] AS g, max(f) AS around FROM f, range(2, 4) m(m), range(1, 4) i(i) WHERE m < k AND i + m - 1 <= k GROUP BY 1, 2),
kept AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score::BIGINT AS score FROM best b LEFT JOIN inside s ON s.lang = b.lang AND s.g = b.g
  WHERE s.around IS NULL OR 100 * s.around < 80 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang)
QUALIFY rank <= 2000""",
    "op7_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT c.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n ON c.vec_id = n.vec_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
