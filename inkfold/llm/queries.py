"""The registered queries of the corpus operators and their SQL."""

from pyspark.sql import DataFrame, SparkSession

from inkfold.llm.exact_dedup import exact_dedup
from inkfold.llm.jaccard_join import near_duplicates
from inkfold.llm.language import identify
from inkfold.llm.nearest import nearest_neighbours
from inkfold.llm.packing import best_fit_packing
from inkfold.llm.periodic import periodic_runs
from inkfold.llm.personal_data import personal_data
from inkfold.llm.pieces import piece_encoding
from inkfold.llm.repetition import repetition_rules
from inkfold.llm.secret_scan import secret_scan
from inkfold.llm.substring_dedup import substring_dedup
from inkfold.llm.suffix_dedup import suffix_dedup
from inkfold.llm.vector_codes import vector_codes


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sequence, of which permitted length, holds each document or piece of one?"""
    return best_fit_packing(documents(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which secrets does each document hold, and do they look live or copied?"""
    return secret_scan(documents(spark, sf_dir)).drop("sig", "span_list")


def op3_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What are the best segmentations of each document into sentence pieces?"""
    return piece_encoding(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which bytes of each document stand in an earlier one too?"""
    return suffix_dedup(documents(spark, sf_dir))


def op5_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How repetitive is each document, and does it stay?"""
    return repetition_rules(documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which language is each document in?"""
    return identify(documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of each document lie in a passage that occurs more than once?"""
    return substring_dedup(documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents repeat another one's text, and which one stays?"""
    return exact_dedup(documents(spark, sf_dir))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where does each document hold personal data?"""
    return personal_data(documents(spark, sf_dir))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are near copies of each other, directly or through others?"""
    return near_duplicates(documents(spark, sf_dir))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which codebook entries stand for each vector, and how far off are they?"""
    return vector_codes(embeddings(spark, sf_dir))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stretches of each document repeat with a period, and what is left without them?"""
    return periodic_runs(documents(spark, sf_dir))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which vectors have the largest inner products with each queried one?"""
    return nearest_neighbours(embeddings(spark, sf_dir))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_secret_scan": op2_secret_scan,
    "op3_piece_encoding": op3_piece_encoding,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_repetition_rules": op5_repetition_rules,
    "op6_language_id": op6_language_id,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_personal_data": op9_personal_data,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_vector_codes": op11_vector_codes,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}

ORACLE_SQL = {
    "op8_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id,
                regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
            FROM documents
        )
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
            doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)
    """,
    # The shingles of whole texts, all pairs that share one, and reachability over the links.
    "op10_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
            FROM words, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS t(i)
        ), sizes AS (
            SELECT w.doc_id, count(s.s) AS n FROM words w LEFT JOIN shingles s USING (doc_id) GROUP BY 1
        ), shared AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT x, y FROM shared
            JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
            WHERE 100 * n_both >= 75 * (p.n + q.n - n_both)
        ), reached(doc_id, seen) AS (
            SELECT doc_id, doc_id FROM words
            UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.seen
        )
        SELECT s.doc_id, s.n AS n_shingles, min(r.seen) AS component_id
        FROM sizes s JOIN reached r USING (doc_id) GROUP BY 1, 2
    """,
}
