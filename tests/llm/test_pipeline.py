import corpus_pipeline
from quarrylens.llm import decontaminate, mixing, pii
from quarrylens.llm.shared import store


def test_stages_pass_on_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, tiny).checkpoint() if spark.sparkContext.getCheckpointDir() else stage(spark, docs, tiny).cache()
        assert docs.columns == before.columns, name
        assert docs.count() <= before.count()
    items = spark.read.parquet(f"{tiny}/benchmark.parquet")
    assert decontaminate.find(docs, items).where("item_id is not null").count() == 0
    assert pii.find(docs, pii.Judge(None, {})).where("base <> ''").count() == 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, tiny)
    assert mixed.count() == docs.count() and set(mixing.mix(docs).columns) == set(mixed.columns)


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "pii", "mixing"]


def test_stages_on_odd_rows(spark, tiny):
    """Nulls, blanks, a very long text, repeats and clashing columns; then an empty table."""
    rows = [(None, "no id", "a"), (1, None, "a"), (2, "", None), (3, "  \n", "b"), (4, "same", "b"), (4, "same", "b"), (5, "w " * 30_000, "b"), (6, "mail a.b@c.de " * 3000, None)]
    clash = "doc_id long, text string, lang string, source string, n_chars long, h_0 string, x_0 string, score string, size string, least string"
    odd = spark.createDataFrame([(i, t, None, s, None if t is None else len(t), "h", "x", "s", "z", "l") for i, t, s in rows], clash)
    empty = odd.limit(0)
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        odd, empty = (store(stage(spark, d, tiny), name) for d in (odd, empty))
        assert odd.columns == empty.columns == [c.split()[0] for c in clash.split(", ")], name
        assert empty.count() == 0
        counts.append(odd.count())
        assert {r.h_0 for r in odd.collect()} == {"h"}
    assert counts == [8, 7, 7, 7]
    kept = {r.doc_id: r for r in odd.collect()}
    assert set(kept) == {None, 1, 2, 3, 4, 5, 6} and kept[1].text is None and kept[2].text == "" and kept[5].n_chars == 60_000
    assert kept[6].text == "mail [EMAIL] " * 3000 and kept[6].n_chars == len(kept[6].text)
    mix = corpus_pipeline.STAGES[-1][1]
    assert mix(spark, odd, tiny).count() == 7 and mix(spark, empty, tiny).count() == 0
