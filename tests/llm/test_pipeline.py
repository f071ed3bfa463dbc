import corpus_pipeline as cp
from lumenfold.llm import linededup, mixing, pieces, simhash, toxicity


def test_stages_in_turn(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    toxic = cp.reject_toxic(spark, docs, sf)
    bad = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).where("predicted = 1").collect()}
    assert {r.doc_id for r in toxic.collect()} == {r.doc_id for r in docs.collect()} - bad and toxic.columns == names and bad
    lines = cp.dedup_lines(spark, toxic, sf)
    assert lines.count() == toxic.count() and lines.columns == names
    assert {(r.doc_id, r.text) for r in lines.collect()} == {(r.doc_id, r.text) for r in linededup.dedup_lines(toxic).collect()}
    near = cp.dedup_near(spark, lines, sf)
    groups = {r.component_id for r in simhash.near_duplicates(lines.select("doc_id", "text")).collect()}
    assert {r.doc_id for r in near.collect()} == groups and near.columns == names
    mixed = cp.mix(spark, near, sf)
    assert mixed.columns == names and mixed.count() == mixing.poisson_mix(near, seed=cp.MIX_SEED).count()
    encoded = cp.encode(spark, mixed, sf)
    assert encoded.where("round_trip").count() == mixed.count()
    run = cp.run(spark, sf)
    assert sorted((r.doc_id, tuple(r.piece_ids)) for r in run.collect()) == sorted((r.doc_id, tuple(r.piece_ids)) for r in encoded.collect())


def test_edges(spark, tmp_path):
    sf = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    rows = [(1, None, None, None, None, "a"), (2, "", "en", "s", 0, "b"), (3, "x y z", "en", "s", 5, None), (3, "x y z", "en", "s", 5, None), (None, "x y z", None, None, 5, "c")]
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in cp.STAGES:
            docs = stage(spark, docs, sf)
            assert name == "pieces" or docs.columns == [c.split()[0] for c in schema.split(", ")]
        assert docs.count() == 0 if not data else docs.count() >= 0


def test_names():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "pieces"] and cp.ORACLE_SQL is None
    assert pieces.DEFAULT_MODEL
