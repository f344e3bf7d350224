import corpus_pipeline
from quarry.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns, before = docs.columns, docs.count()
    assert [f for _, f in corpus_pipeline.STAGES][0] is corpus_pipeline.quality and len(corpus_pipeline.STAGES) == 5
    junk = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    folder = corpus_pipeline.shared_folder(spark)
    sizes = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        path = f"{folder}/test-stage-{k}-{id(docs)}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert before > sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0.5 * before
    left = {r["doc_id"] for r in docs.collect()}
    assert len(left & junk) <= 0.2 * len(junk)
    assert corpus_pipeline.run(spark, SF).count() == sizes[-1]


def test_stages_take_odd_rows(spark, edge):
    docs = edge.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) as n_chars", "score", "ids")
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, SF).count() >= 1
        assert stage(spark, docs.where("false"), SF).count() == 0
    assert corpus_pipeline.quality(spark, docs, SF).columns == docs.columns


def test_cut_texts_stay_with_their_rows(spark):
    passage = " ".join(f"passage{k}" for k in range(20))
    rows = [(1, passage), (None, "first null " + passage + " tail"), (None, "second null"), (None, passage), (None, None),
            (6, "six " + passage), (6, "another six"), (6, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "'en' as lang", "'a' as source", "cast(length(text) as long) as n_chars")
    got = corpus_pipeline.suffix_dedup_stage(spark, docs, SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == [
        (0, ""), (0, "first null tail"), (0, "second null"), (1, passage), (6, "another six"), (6, "six ")]
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)


def test_texts_are_cut_without_a_join_of_all_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cut = corpus_pipeline.suffix_dedup_stage(spark, docs, SF)
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    # the table of texts: once for the open runs, once for the result, both dealt by one exchange
    assert plan.count("RepartitionByExpression [key") == 2
    assert plan.count("[__row") == 0 and plan.count("Join LeftOuter, (__row") == 0
    assert cut.columns == docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    for r in cut.collect():  # other columns stay with their rows
        assert all(r[c] == before[r["doc_id"]][c] for c in docs.columns if c not in ("text", "n_chars"))


def test_queries_return_their_rows(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert set(queries.queries()) == {"op1_quality", "op2_bpe", "op3_suffix_dedup", "op4_lm_score", "op5_toxicity",
                                      "op6_rules", "op7_near_dedup", "op8_decontamination", "op9_extraction",
                                      "op10_sharding", "op11_hard_negatives", "op12_fingerprints", "op13_search"}
    for name in ("op2_bpe", "op3_suffix_dedup", "op4_lm_score", "op6_rules", "op8_decontamination", "op10_sharding", "op12_fingerprints"):
        assert queries.queries()[name](spark, SF).count() == n
