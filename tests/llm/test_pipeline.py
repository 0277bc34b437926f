"""Every stage works on what its predecessor kept, and its decisions take effect."""

import corpus_pipeline
from verbflow.llm import queries


def test_stages(spark, tmp_path, prose):
    passage = prose(60, 1)
    clean = [(i, prose(80, 100 + i)) for i in range(60)]
    toxic = [(100 + i, prose(40, 200 + i) + " worthless scum idiot " + prose(20, 300 + i)) for i in range(20)]
    copies = [(200, clean[0][1]), (201, clean[1][1] + " end"), (202, prose(40, 400) + " " + passage), (203, passage + " " + prose(40, 401)), (204, "123 $$"), (205, None), (206, "")]
    rows = [*clean, *toxic, *copies]
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(100 <= i < 200)) for i, _ in rows if i < 200], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen, at = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out{k}"))
        at = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen[name] = at.collect()
    ids = {name: {r.doc_id for r in v} for name, v in seen.items()}
    assert ids["toxicity"] == {i for i, _ in rows if not 100 <= i < 200}
    assert ids["language"] == ids["toxicity"] - {204, 205, 206}
    assert ids["near duplicates"] == ids["language"] - {200, 201}
    texts = {r.doc_id: r.text for r in seen["repeated passages"]}
    assert texts[202].endswith(passage) and passage not in texts[203] and all(texts[i] == t for i, t in clean)
    assert ids["packing"] == ids["near duplicates"]
    rerun = corpus_pipeline.run(spark, str(tmp_path))
    assert rerun.count() == len(seen["packing"])


def test_near_duplicates_of_shared_ids(spark, prose):
    """Different texts of one id are documents of their own; of equal rows and of near copies one stays."""
    a, b, c = prose(60, 1), prose(60, 2), prose(60, 3)
    rows = [(1, a), (1, b), (2, a + " end"), (None, b + " end"), (None, c), (3, b), (3, b), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(((r.doc_id or 0, r.text or "") for r in out.collect())) == sorted([(1, a), (1, b), (0, c), (4, ""), (5, "")])


def test_one_query_for_each_operator():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert set(queries.ORACLE) <= set(queries.QUERIES)
