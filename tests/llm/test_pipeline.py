import corpus_pipeline
from lodescan.llm import queries
from lodescan.llm.exact_dedup import exact_dedup
from lodescan.llm.mixing import mix
from lodescan.llm.packing import pack
from lodescan.llm.quality_cnn import classify
from lodescan.llm.simhash import simhash_components


def columns(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_stages_follow_their_operators(spark, tmp_path):
    """Each stage keeps what its operator says, over all that its predecessor kept."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    kept = docs
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, kept, sf)
        if name == "packing":
            assert columns(found.drop("sequence_id", "offset")) == columns(
                pack(kept).drop("sequence_id", "offset"))
            continue
        assert found.columns == names
        found.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        if name == "quality":
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            wanted = classify(kept, labels).filter("predicted = 1")
        elif name == "exact_dedup":
            wanted = exact_dedup(kept).filter("kept")
        elif name == "near_dedup":
            wanted = simhash_components(kept).filter("doc_id = component_id")
        else:
            wanted = mix(kept, budget=corpus_pipeline.MIX_BUDGET, max_epochs=1).filter("copies > 0")
        assert ids == {r["doc_id"] for r in wanted.select("doc_id").collect()}
        assert after.count() == len(ids)
        assert columns(after) == columns(kept.filter(kept["doc_id"].isin(sorted(ids))))
        kept = after


def test_run_is_all_stages(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and "sequence_id" in rows.columns


def test_no_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").collect() == []


def test_odd_documents(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, "/root/testdata/sf0.001")
        assert found.count() <= docs.count() or name == "packing"
        assert name == "packing" or found.columns == docs.columns


def test_queries_equal_their_sql(spark):
    from checks.compare import canonical, connect

    connection = connect("/root/testdata/sf0.001")
    for name, sql in queries.ORACLE.items():
        ours = canonical(queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas())
        assert ours == canonical(connection.execute(sql).df()), name
