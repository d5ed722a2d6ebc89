import corpus_pipeline
import __spark_entry__ as entry
from labelloom.llm import QUERIES, SQL, bpe, pii, quality
from tests.llm import data
from tests.llm.test_dedup import classes_by_brute_force
from tests.llm.test_leaks import plain_leaks


def test_every_operator_is_registered():
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in entry.queries()) == 1
    assert set(SQL) <= set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()


def test_stages_equal_brute_force(spark, sf_dir):
    docs = data.table(spark, sf_dir, "documents")
    functions = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(functions) == 5

    good = functions["quality classifier"](spark, docs, sf_dir)
    accepted = {r.doc_id for r in quality.rank(docs, data.table(spark, sf_dir, "labels")).filter("predicted = 1").collect()}
    assert {r.doc_id for r in good.collect()} == accepted

    single = functions["near duplicates"](spark, good, sf_dir)
    classes = classes_by_brute_force([(r.doc_id, r.text) for r in good.collect()])
    assert {r.doc_id for r in single.collect()} == set(classes.values())

    clean = functions["benchmark decontamination"](spark, single, sf_dir)
    items = [(r.item_id, r.text) for r in data.table(spark, sf_dir, "benchmark").collect()]
    leaked = {d for d, _ in plain_leaks([(r.doc_id, r.text) for r in single.collect()], items)}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - leaked

    masked = functions["personal data"](spark, clean, sf_dir)
    field = pii.fitted()
    expected = {}
    for r in clean.collect():
        base, more = pii.all_spans(r.text, field)
        expected[r.doc_id] = pii._masked(r.text, [*base, *more])
    assert {r.doc_id: r.text for r in masked.collect()} == expected
    assert all(r.n_chars == len(r.text) for r in masked.collect())
    for frame in (good, single, clean, masked):
        assert frame.columns == docs.columns and frame.dtypes == docs.dtypes

    last = functions["byte-pair encoding"](spark, masked, sf_dir).collect()
    codec = bpe.Codec(bpe.load(bpe.vocabulary_path()))
    assert {r.doc_id: r.ids for r in last} == {k: codec.ids(t).tolist() for k, t in expected.items()}
    assert all(r.decoded_sha256 == data.sha(expected[r.doc_id]) for r in last)
    assert {tuple(r) [:4] for r in entry.queries()["pipeline"](spark, sf_dir).drop("ids").collect()} == {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in last}


def test_stages_with_odd_inputs(spark, sf_dir):
    for docs in (data.odd(spark), data.empty(spark)):
        for _, function in corpus_pipeline.STAGES:
            docs = function(spark, docs, sf_dir)
            docs.collect()
