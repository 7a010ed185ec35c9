"""The pipeline's stages against plain versions, each on its own input."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from kmerloom.llm import bpe, quality, secrets

from .odd import empty_docs, odd_docs
from .test_decontaminate import plain as plain_contamination
from .test_near_duplicates import plain as plain_classes
from .test_rowwise import PLAIN

AT = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = corpus_pipeline.table(spark, AT, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.fit(docs, corpus_pipeline.table(spark, AT, "labels"))
    scores = dict(zip(rows, model.scores([(r.text or "").encode() for r in rows.values()])))
    kept = [i for i in rows if scores[i] >= 0.5]
    classes = plain_classes([(i, rows[i].text) for i in kept])
    kept = [i for i, c, _ in classes if i == c]
    bench = [(r.item_id, r.text) for r in corpus_pipeline.table(spark, AT, "benchmark").collect()]
    kept = [r[0] for r in plain_contamination([(i, rows[i].text) for i in kept], bench) if not r[2]]
    want = {}
    for i in kept:
        text = secrets._redact(rows[i].text, secrets.joined(secrets.scan(rows[i].text)[1]), "[SECRET]")
        want[i] = PLAIN.encode(text, add_special_tokens=False).ids
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, AT).collect()}
    assert got == want and 100 < len(got) < 200


def test_stages_keep_columns_and_take_odd_rows(spark):
    mine = {c: F.lit("mine") for c in ("score", "quality_score", "_quality", "_id", "_hash", "_rows", "_h", "_doc_id", "_row", "key", "first", "again", "blank", "bad", "label", "h")}
    for docs in (odd_docs(spark).withColumns(mine), empty_docs(spark).withColumns(mine)):
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            n, docs = docs.count(), (stage(spark, docs, AT) if k < 4 else docs)
            assert docs.columns == columns and docs.count() <= n and docs.where(" or ".join(f"{c} <> 'mine' or {c} is null" for c in mine)).isEmpty()
        assert bpe.encode(docs).count() == docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality" and corpus_pipeline.ORACLE_SQL is None
