from __future__ import annotations

import corpus_pipeline
from loresift.llm import queries, toxicity
from loresift.llm.common import read_table, settle
from tests.llm import plain
from tests.llm.conftest import ODD
from tests.llm.test_exact_dedup import normal
from tests.llm.test_packing import check

FOLDER = "/root/testdata/sf0.001"


def test_stages_do_their_whole_job(spark):
    docs = read_table(spark, FOLDER, "documents")
    stages = dict(corpus_pipeline.STAGES)
    labels = read_table(spark, FOLDER, "labels")
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, labels).where("predicted = 1").collect()}

    clean = stages["toxicity"](spark, docs, FOLDER)
    kept = {r.doc_id: r.text for r in clean.collect()}
    assert set(kept) == {r.doc_id for r in docs.collect()} - toxic

    first = {}
    for i, t in sorted(kept.items()):
        first.setdefault(normal(t), i)
    once = stages["exact_dedup"](spark, clean, FOLDER)
    assert {r.doc_id for r in once.collect()} == set(first.values())

    kept = {i: kept[i] for i in first.values()}
    groups = plain.near_components(kept, 5)
    single = stages["near_dedup"](spark, once, FOLDER)
    assert clean.columns == once.columns == single.columns == docs.columns
    assert {r.doc_id for r in single.collect()} == {i for i, c in groups.items() if i == c}

    rows = corpus_pipeline.run(spark, FOLDER).collect()
    check(rows, [(i, kept[i]) for i, c in groups.items() if i == c], 2048, 1)


def test_odd_rows_pass_every_stage(spark, odd):
    """Null, empty and repeated texts and ids, and columns whose names clash with inner ones."""
    rows = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, rows, FOLDER)
        assert kept.columns == odd.columns, name
        rows = settle(kept, name)
    texts = [(r.doc_id, r.text) for r in rows.collect()]
    # of texts equal but for white space and case one row stays, whatever its id
    assert len(texts) == len({plain.lower(normal(t)) for _, t in ODD})
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, FOLDER).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in texts} and sum(r.start == 0 for r in packed) == len(texts)
    none = odd.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, FOLDER).count() == 0, name


def test_texts_of_one_id_stay_or_go_by_themselves(spark, docs):
    texts = ["one text of an id that is held by two rows", "quite another text which has nothing to do with it"]
    rows = docs((5, texts[0]), (5, texts[1]), (5, texts[0]), (6, texts[0] + " and more"))
    kept = corpus_pipeline.drop_near_copies(spark, rows, FOLDER).collect()
    assert sorted(r.text for r in kept if r.doc_id == 5) == sorted(texts)


def test_every_query_is_registered():
    import __spark_entry__

    assert {*queries.QUERIES, "pipeline"} <= set(__spark_entry__.queries())
    assert [k.split("_")[0] for k in sorted(queries.QUERIES, key=lambda k: int(k[2:].split("_")[0]))] == [
        f"op{n}" for n in range(1, 14)
    ]
