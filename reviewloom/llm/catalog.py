"""The corpus operators as queries over the sample tables, with their SQL."""

from pyspark.sql import functions as F

from corpus_pipeline import ORACLE_SQL, run

from reviewloom.llm import (
    decontamination,
    exact_dedup,
    language_id,
    license_scan,
    line_dedup,
    near_dedup,
    packing,
    quality,
    spelling,
    suffix_dedup,
    url_filter,
    vector_codes,
    warc,
)
from reviewloom.llm.common import table, tokenizer_path
from reviewloom.llm.oracles import OPERATORS


def op1_language_id(spark, sf_dir):
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def op2_url_filters(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op3_warc(spark, sf_dir):
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("n_points")


def op5_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).drop("kept")


def op7_minhash_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_license_scans(spark, sf_dir):
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark, sf_dir):
    return suffix_dedup.drop_repeated_passages(table(spark, sf_dir, "documents"))


def op10_decontamination(spark, sf_dir):
    hits = decontamination.benchmark_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


def op11_quality_classifier(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_codes(spark, sf_dir):
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {name: query for name, query in sorted(globals().items()) if name.startswith("op") and callable(query)}
QUERIES["pipeline"] = run
ORACLES = OPERATORS | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
