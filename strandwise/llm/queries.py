"""The registered queries of the operators, on their whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandwise.llm.alignment import aligned
from strandwise.llm.cluster import shared_dir
from strandwise.llm.decontaminate import contaminated
from strandwise.llm import pseudo
from strandwise.llm.edits import recount, with_sample_edits
from strandwise.llm.fingerprint import edited_fingerprints
from strandwise.llm.lines import drop_repeated_lines
from strandwise.llm.mixing import mixed
from strandwise.llm.simhash import hex_print, near_duplicates
from strandwise.llm.substring import remove_repeats
from strandwise.llm.tokens import read_corpus, write_corpus
from strandwise.llm.toxicity import fit, score
from strandwise.llm.vectorcodes import vector_codes
from strandwise.llm.warc import derivatives, responses

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_corpus(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_BPE), end_id=2)
    return read_corpus(spark, path, with_ids=False)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recount(with_sample_edits(table(spark, sf_dir, "documents")), public_tokenizers.path(BYTE_BPE))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pseudo.score(docs, pseudo.fit(docs))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_print("fp").alias("fingerprint"), "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(table(spark, sf_dir, "documents"), with_text=False)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_mixing": op2_mixing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_decontamination": op5_decontamination,
    "op6_fingerprints": op6_fingerprints,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_warc": op10_warc,
    "op11_line_dedup": op11_line_dedup,
    "op12_vector_codes": op12_vector_codes,
    "op13_alignment": op13_alignment,
}

#: DuckDB SQL for the rows of the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op3_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM d),
        win AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 20], ' ') AS s FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 19, 0))) AS i FROM d)),
        firsts AS (SELECT s, min((doc_id, i)) AS m FROM win GROUP BY s HAVING count(*) > 1),
        covered AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN firsts USING (s), range(20) r(j) WHERE (doc_id, i) > m),
        kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words w ANTI JOIN covered USING (doc_id, p) GROUP BY 1)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op11_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS p FROM d),
        keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
        often AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS text, count(*) AS n FROM keyed LEFT JOIN often USING (k) WHERE last IS NULL OR last = doc_id GROUP BY 1)
        SELECT d.doc_id, len(l)::BIGINT AS n_lines, (len(l) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
}
