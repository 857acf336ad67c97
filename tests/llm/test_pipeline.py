import corpus_pipeline
from millrace.llm.common import stage


def test_stages_keep_the_columns_and_pack_all_words(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    schema, sizes = docs.schema, []
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, sf), name)
        assert docs.schema == schema
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_clean_documents_stay_and_copies_go(spark, written):
    rows = [(i, " ".join(f"word{i}x{j}" for j in range(80)), "en", "s", 0) for i in range(12)]
    rows += [(100 + i, rows[0][1], "en", "s", 0) for i in range(3)] + [(200, None, "en", "s", 0), (201, "123", "en", "s", 0), (202, "", None, None, None)]
    docs = written(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, step in corpus_pipeline.STAGES[:3]:
        docs = stage(step(spark, docs, ""), "t")
    assert {r.doc_id: r.text for r in docs.collect()} == {r[0]: r[1] for r in rows[:12]}


def test_empty_input(spark, written):
    docs = written([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, ""), "t")
        assert docs.count() == 0


def test_stages_leave_their_tables_to_lazy_results(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120")
    kept = corpus_pipeline.near_duplicates(spark, docs, sf)
    cut = corpus_pipeline.substring_dedup(spark, kept, sf)
    mixed = corpus_pipeline.source_mix(spark, cut, sf)
    other = corpus_pipeline.near_duplicates(spark, docs.where("doc_id < 60"), sf)
    assert mixed.count() and cut.count() <= kept.count() <= 120 and other.count() <= 60
