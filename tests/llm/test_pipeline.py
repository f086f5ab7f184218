import corpus_pipeline as pipeline
from helpers import ODD, no_rows, odd_rows, shingle_set, table
from pyspark.sql import functions as F
from test_packing import check

from heddle.llm import line_dedup, quality, secret_scan
from heddle.llm.common import materialise


def documents(spark):
    rows = odd_rows(spark).withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
    return rows.withColumns({c: F.lit("clash") for c in ("n_removed", "hash", "keys", "size", "fingerprint", "n_format")})


def test_stages_on_odd_and_no_rows(spark):
    for docs in (documents(spark), no_rows(spark).withColumns({"lang": F.lit("en"), "n_chars": F.lit(0).cast("long")}).select(*pipeline.COLUMNS)):
        for k, (_, stage) in enumerate(pipeline.STAGES):
            docs = materialise(stage(spark, docs, ""))
            if k < len(pipeline.STAGES) - 1:
                assert docs.columns == list(pipeline.COLUMNS)
    assert len(ODD) > 0


def test_stages_take_effect(spark, small):
    folder = small.replace("sf0.001", "sf0.01")
    docs = table(spark, folder, "documents")
    labels = {r.doc_id: r.quality for r in table(spark, folder, "labels").collect()}
    seen = [docs]
    for _, stage in pipeline.STAGES[:-1]:
        seen.append(materialise(stage(spark, seen[-1], folder)))
    texts = [{r.doc_id: r.text for r in d.collect()} for d in seen]
    raw, good, lines, unique, clean = texts
    _, scorer = quality.fit(docs)
    assert set(good) == {i for i, x in raw.items() if scorer.score(x or "") >= quality.KEEP}
    assert sum(i in good for i, q in labels.items() if q) >= 0.99 * sum(labels.values())
    assert lines == {r.doc_id: r.text for r in line_dedup.drop_boilerplate(seen[1]).collect()} and lines.keys() == good.keys()
    assert len(set(unique.values())) == len(unique)
    sets = {i: shingle_set(x.encode(), 5) for i, x in lines.items()}
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    for i in lines.keys() - unique.keys():
        assert any(j < i and alike(i, j) for j in lines) or any(j != i and alike(i, j) for j in lines)
    for i in unique:
        for j in unique:
            assert i >= j or not alike(i, j)
    assert clean.keys() == unique.keys() and not any(secret_scan.base_spans(x) for x in clean.values())
    assert {r.doc_id: r.n_chars for r in seen[-1].collect()} == {i: len(x) for i, x in clean.items()}


def test_run(spark, small):
    rows = pipeline.run(spark, small).collect()
    docs = table(spark, small, "documents")
    for _, stage in pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, small))
    used, least = check(spark, rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert used <= least * 1.02 + 1
