"""The corpus pipeline against its stages applied plainly."""

import corpus_pipeline
from veritrail.llm import bpe_codec, lang_id, pii, simhash
from veritrail.llm.lineage import written


def test_pipeline_equals_plain_stages(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = lang_id.train(docs)
    first = {i for i, r in rows.items() if (c := lang_id.subwords(r.text)) is not None and model.scores(c).max() >= model.cut}
    prints = {i: simhash.fingerprint(rows[i].text) for i in sorted(first)}
    second: set[int] = set()
    open_ = set(prints)
    while open_:
        group, todo = set(), [min(open_)]
        while todo:
            i = todo.pop()
            group.add(i)
            todo += [j for j in open_ - group if (prints[i] ^ prints[j]).bit_count() <= 4 and j not in todo]
        second.add(min(group))
        open_ -= group
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    third = {i for i in second if not any(t in rows[i].text for t in items)}
    stages = [(n, f) for n, f in corpus_pipeline.STAGES]
    now, got = docs, []
    for name, stage in stages[:-1]:
        now = written(stage(spark, now, sf_dir), name)
        assert now.columns == docs.columns
        got.append({r.doc_id for r in now.select("doc_id").collect()})
    assert got[:2] == [first, second]
    assert got[2] <= second and not any(t in rows[i].text for i in got[2] for t in items)
    assert len(second) - len(got[2]) <= len(second - third) + 2 and got[3] == got[2]
    before = docs.where(docs.doc_id.isin(sorted(got[2])))
    field = pii.train(before)
    coder = bpe_codec.codec(public_tokenizers.path("word_bpe_49k.json"))
    masked = {r.doc_id: r.text for r in now.select("doc_id", "text").collect()}
    assert masked == {i: pii.masked_text(rows[i].text, field) for i in got[3]}
    final = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert final == {i: coder.encode(t or "") for i, t in masked.items()}


def test_stages_on_odd_rows(spark, sf_dir):
    rows = [(1, None, None, None, None), (None, "the words of this text are here", "en", "s", 1), (2, "", "en", None, 0), (3, "the words of this text are here", "en", "s", 1), (3, "the words of this text are here", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, sf_dir)
            assert out.columns == docs.columns
            assert out.count() <= table.count()
        assert corpus_pipeline.STAGES[-1][1](spark, table, sf_dir).count() == table.count()
