import corpus_pipeline
from lodestring.llm import common, quality, substring_dedup

from test_near_copies import brute


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "toxicity", "SimHash near-dedup", "substring dedup", "packing"]
    step = docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        before = step
        step = corpus_pipeline.stage(function(spark, before, sf_dir), "test")
        assert step.dtypes == docs.dtypes
        old, new = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in step.collect()}
        assert set(new) <= set(old) and new
        if name == "quality rules":
            judged = {r.doc_id: r for r in quality.judge_quality(before).collect()}
            assert set(new) == {d for d, r in judged.items() if r.kept}
            assert all(new[d].text == judged[d].cleaned and new[d].n_chars == len(new[d].text) for d in new)
        if name == "SimHash near-dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            first = {}
            for (d, _), component in zip(rows, brute(rows)):  # five-word shingles, similarity 0.8
                first[component] = min(first.get(component, d), d)
            assert set(new) == set(first.values()) and all(new[d] == old[d] for d in new)
        if name == "substring dedup":
            done = {r.doc_id: r for r in substring_dedup.substring_dedup(before).collect()}
            assert all(new[d].text == (done[d].kept_text if done[d].n_removed else old[d].text) for d in new)
    packed = corpus_pipeline.STAGES[-1][1](spark, step, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(new)


def test_empty_documents(spark, sf_dir):
    step = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, function in corpus_pipeline.STAGES:
        step = corpus_pipeline.stage(function(spark, step, sf_dir), "test")
    assert step.count() == 0


def test_rows_with_nulls_repeats_and_clashing_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    some = docs.limit(40)
    empty = docs.limit(1).selectExpr("cast(null as long) doc_id", "cast(null as string) text", "lang", "source", "n_chars")
    extra = ("kept", "score", "n_words", "component_id", "kept_text", "block", "length")
    step = some.unionByName(some).unionByName(empty).unionByName(empty.selectExpr("-1L doc_id", "'' text", "lang", "source", "n_chars"))
    step = step.selectExpr("*", *[f"'x' {c}" for c in extra])
    names = step.columns
    for name, function in corpus_pipeline.STAGES[:-1]:
        step = corpus_pipeline.stage(function(spark, step, sf_dir), "test")
        assert step.columns == names
        rows = step.collect()
        assert all(r[c] == "x" for r in rows for c in extra)
        if name == "SimHash near-dedup":  # a row and its repeat are one group
            assert len({r.doc_id for r in rows}) == len(rows) > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, step, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in rows}


def test_run_leaves_only_the_results_of_its_stages(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    tables = spark.sql("SHOW TABLES").count()
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert len(list((tmp_path / "lodestring").iterdir())) == len(corpus_pipeline.STAGES)
    assert spark.sql("SHOW TABLES").count() == tables
