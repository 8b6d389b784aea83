"""Queries of the text operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, crc_ring, decontam, html_extract, langid, ngram_jaccard, oracle, periodic_runs, pii, setsketch, spm, token_files, toxicity, vptree


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.components_of(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op3_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return vptree.search(rows, rows.where("vec_id % 20 = 0"), k=20, factor=1.0)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=5, threshold=0.8)


def op9_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return spm.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), dropout=0.1)


def op5_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(_table(spark, sf_dir, "pages"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    directory = common.scratch_path(spark, "tokens")
    manifest = token_files.write(_table(spark, sf_dir, "documents"), directory, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(manifest, directory)


def op7_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.digest(pii.detect(docs, pii.fit(docs)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op10_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id bigint, turn bigint, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digest(chat.format_trees(chat.chain(rows)))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find(periodic_runs.with_planted_runs(_table(spark, sf_dir, "documents"))))


def op12_crc_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crc_ring.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), n=3, percent=5).select("doc_id", "n_features", "weight", "score", "rank")


def op13_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.components_of(_table(spark, sf_dir, "documents"), k=2, percent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_vantage_point_search": op3_vantage_point_search,
    "op4_decontamination": op4_decontamination,
    "op5_host_paths": op5_host_paths,
    "op9_merge_dropout": op9_merge_dropout,
    "op6_token_files": op6_token_files,
    "op7_weak_supervision": op7_weak_supervision,
    "op8_toxicity": op8_toxicity,
    "op10_chat_trees": op10_chat_trees,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_crc_ring": op12_crc_ring,
    "op13_setsketch": op13_setsketch,
}

ORACLE_SQL: dict[str, str] = {
    **oracle.SQL,
    "op2_ngram_jaccard": r"""
        WITH RECURSIVE d AS (SELECT doc_id, min(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
             w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
             s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]))) END AS sh FROM w),
             t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
             shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
             links AS (SELECT a, b FROM shared WHERE 100 * c >= 90 * (na + nb - c)),
             lab(node, label) USING KEY (node) AS (
                 SELECT doc_id AS node, doc_id AS label FROM s
                 UNION SELECT links.b AS node, min(lab.label) AS label FROM lab JOIN links ON links.a = lab.node JOIN recurring.lab AS old ON old.node = links.b WHERE lab.label < old.label GROUP BY links.b)
        SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, lab.label AS component_id FROM s JOIN lab ON lab.node = s.doc_id""",
    "op3_vantage_point_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
             ok AS (SELECT DISTINCT ON (vec_id) vec_id, e FROM v
                    WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
                    ORDER BY vec_id, e),
             near AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
                      FROM ok q JOIN ok c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
             ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM near)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op10_chat_trees": r"""
        WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                      UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS own(t, r))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(2 * length(role || text) - length(regexp_replace(role || text, '[\\<\[|]', '', 'g')) + 13) AS BIGINT) AS formatted_chars
        FROM rows GROUP BY conv_id""",
}
