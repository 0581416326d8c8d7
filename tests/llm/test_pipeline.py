import __spark_entry__ as entry_point
import corpus_pipeline
import pytest
from reviewloom.llm import decontamination, exact_dedup, language_id, near_dedup

DIR = "/root/testdata/sf0.001"


def test_each_stage_takes_effect_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(step(spark, docs, DIR), "test")
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > sizes[2] >= sizes[3] >= sizes[4] > 0
    assert docs.select("doc_id").distinct().count() == sizes[-1]
    # nothing is left for any stage to do
    assert exact_dedup.exact_duplicates(docs).filter("NOT kept").isEmpty()
    assert near_dedup.near_duplicates(docs, percent=80).filter("NOT kept").isEmpty()
    benchmark = spark.read.parquet(f"{DIR}/benchmark.parquet")
    assert decontamination.benchmark_overlap(docs, benchmark).filter("contaminated").isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert packed.select("doc_id").distinct().count() == sizes[-1]


def test_run_equals_the_stages(spark):
    got = {(r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, DIR).collect()}
    assert len(got) > 100 and {i for i, _, _ in got} <= set(range(200))


def test_queries_are_registered():
    queries = entry_point.queries()
    assert queries["pipeline"] is corpus_pipeline.run
    assert [sum(n.startswith(f"op{k}_") for n in queries) for k in range(1, 11)] == [1] * 10
    assert set(entry_point.oracle_sql()) <= set(queries)


def test_empty_documents_go_through(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, DIR)
    assert docs.count() == 0


@pytest.mark.parametrize("name", ["op2_url_filters", "op3_warc", "op4_exact_dedup", "op6_line_dedup", "op10_decontamination"])
def test_queries_equal_their_sql(spark, name):
    from check import compare, connect

    assert compare(entry_point.queries()[name](spark, DIR), connect(DIR), entry_point.oracle_sql()[name]) is None


def test_language_stage_keeps_the_sample(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert language_id.keep_identified(docs).count() >= docs.count() - 1
