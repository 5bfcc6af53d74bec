"""The pipeline's stages on a small table."""


def test_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        assert after.columns == docs.columns and after.subtract(docs).count() == 0
        docs = after
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] < counts[0]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_planted_rows_through_all_stages(spark, tmp_path):
    """Copies, leaks, nulls, empty texts and repeated rows: what is clean stays, the rest goes, nothing crashes."""
    import shutil

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    kept = lambda d: {r["doc_id"] for r in corpus_pipeline.run(spark, d).select("doc_id").distinct().collect()}
    before = kept(sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = sorted(i for i in before if 1500 < len(texts[i]) < 8000)[:6]
    passage = max((r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r["text"]), key=len)
    copies = [(100_000 + i, texts[i]) for i in [*clean[:3], clean[0]]]  # one row twice; none with a label, so that the classifiers stay
    leaks = [(200_000 + i, f"{texts[i][: len(texts[i]) // 2]} {passage} {texts[i][len(texts[i]) // 2 :]}") for i in clean[3:]]
    odd = [(300_001, None), (300_002, ""), (300_003, " \n\t"), (None, "too short")]
    rows = [(i, t, "en", "planted", None) for i, t in [*copies, *leaks, *odd]]
    planted = spark.createDataFrame(rows, docs.schema)
    docs.unionByName(planted).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        shutil.copy(f"{sf}/{name}.parquet", tmp_path / f"{name}.parquet")
    after = kept(str(tmp_path))
    assert not after & {i for i, _ in [*copies, *leaks, *odd]}
    assert len(before - after) <= 0.02 * len(before)
    for name in ("empty",):
        docs.limit(0).write.parquet(str(tmp_path / name / "documents.parquet"))
        for t in ("labels", "benchmark"):
            shutil.copy(f"{sf}/{t}.parquet", tmp_path / name / f"{t}.parquet")
        assert corpus_pipeline.run(spark, str(tmp_path / name)).count() == 0
