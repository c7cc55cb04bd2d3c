"""The pipeline's stages against plain versions on a small corpus, each on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfmart.llm import decontaminate, toxicity
from shelfmart.llm.common import written
from tests.llm.conftest import prose
from tests.llm.test_text_sets import _component_ids, _labelled

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    labelled = _labelled(700)
    texts = [(i, t) for i, t, _ in labelled]
    item = prose(77, 40)
    page = prose(78, 200)
    texts += [(2000, page), (2001, page + " more"), (2002, page), (2002, page), (2003, None), (None, prose(79, 50))]
    texts += [(2100, prose(80, 30) + " " + " ".join(item.split()[3:25]) + " " + prose(81, 30))]
    texts += [(2200, prose(82, 60) + " write to some.one@mail3.example.com or +1 (017) 555-7713 " + prose(83, 20))]
    rows = [(i, t, "en", "web", len(t) if t is not None else None) for i, t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 0, y) for i, _, y in labelled]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(84, 30))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {i: y for i, _, y in labelled}, item


def test_stages(spark, corpus):
    folder, toxic, item = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = written(stage(spark, docs, folder), name)
        assert docs.columns == COLUMNS, name
        kept[name] = [tuple(r) for r in docs.collect()], [tuple(r) for r in before.collect()]

    after, before = kept["toxicity"]
    gone = {r[0] for r in before} - {r[0] for r in after}
    wrong = [i for i, y in toxic.items() if (i in gone) != bool(y)]
    assert len(wrong) < 0.03 * len(toxic) and not {i for i in gone if i is None or i >= 2000}

    after, before = kept["near_duplicates"]
    groups = {c for _, n, c in _component_ids([(r[0], r[1]) for r in before]) if n and c is not None}
    empty = {r[0] for r in before if not (r[1] or "").split()}
    assert sorted(r[0] for r in after if r[0] is not None) == sorted(groups | empty)
    assert sum(r[0] is None for r in after) == 1

    after, before = kept["decontamination"]
    automaton = decontaminate.SuffixAutomaton([("1", decontaminate.words_of(item))])

    def clean(text):
        words = decontaminate.words_of(text)
        hit = sum(b - a for a, b in automaton.hits(words)[0])
        return not (hit and 20 * hit >= len(words))

    assert sorted(map(str, after)) == sorted(str(r) for r in before if clean(r[1]))
    assert 2100 not in {r[0] for r in after}

    after, before = kept["personal_data"]
    assert len(after) == len(before)
    texts = {r[0]: r for r in after}
    assert "write to <email> or <phone> " in texts[2200][1] and texts[2200][4] == len(texts[2200][1])
    changed = {r[0] for r in after} - {r[0] for r in after if r in set(before)}
    assert changed == {2200}

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    places = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert places.where("n > 4096 or n <> end").count() == 0
    assert packed.select("doc_id").distinct().count() == len({r[0] for r in after})


def test_run_gives_the_last_stage(spark, corpus):
    out = corpus_pipeline.run(spark, corpus[0])
    assert out.columns[:3] == ["doc_id", "piece", "start"] and out.count() > 40
    assert toxicity.THRESHOLD == 0.3
