"""Whole jobs on small landed files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom import fixed, schemas
from labelloom.plans import attempts, classifier, corpus, null_class, papers, splits, synthesis
from labelloom.sources import publish, readers, staging, writers
from labelloom.streaming import landing
from labelloom.suite import analysis

EN = "The results of this study are in the paper that we have from the field"
DE = "Die Ergebnisse der Studie sind nicht mit dem Feld auf das Ende"


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_unknown_format(spark, tmp_path):
    with pytest.raises(TypeError):
        readers.read_data(spark, str(tmp_path), schemas.ABSTRACTS, format="xml")
    with pytest.raises(TypeError):
        writers.write_corpus(spark.range(1), str(tmp_path), True, True, format="xml")


def test_csv_columns_by_name(spark, tmp_path):
    path = tmp_path / "community.csv"
    path.write_text('doi\ttext\tx\tsdg\tagreement\n1\t"a ""q""\nb"\t0\t3\t0.5\n')
    got = readers.read_data(spark, str(path), schemas.COMMUNITY, "csv", delimiter="\t")
    assert got.collect()[0] == ('a "q"\nb', 3, 0.5)


def test_csv_headers_are_compared(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text\n1,x\n")
    (tmp_path / "b.csv").write_text("text,id\ny,2\n")
    with pytest.raises(Exception, match="header"):
        readers.read_csv(spark, str(tmp_path), "id int, text string").collect()


@pytest.mark.parametrize("row", ["1,x,y,z", "1"])
def test_broken_csv_rows_fail(spark, tmp_path, row):
    (tmp_path / "a.csv").write_text(f"id,text,lang\n1,x,en\n{row}\n")
    with pytest.raises(Exception):
        readers.read_csv(spark, str(tmp_path), "id int, text string").collect()


def test_csv_keeps_blanks_and_tabs(spark, tmp_path):
    rows = [("  lead",), ("trail  ",), ("\ttab\t",), ('say "x, y"\nz',), ("",)]
    path = writers.write_csv(spark.createDataFrame(rows, "text string").withColumn("n", F.lit(1)), str(tmp_path / "t"))
    got = readers.read_csv(spark, path, "text string, n int")
    assert values(got.fillna(""), "text") == sorted(rows)


def test_malformed_json_fails(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"ID": "1", "ABSTRACT": "t", "SDG": 1}\n{broken\n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(path), schemas.ABSTRACTS).collect()


def test_model_tree(spark, tmp_path):
    for model, goal in (("llama-3-70b", 1), ("llama-3-70b", 2), ("other", 1)):
        folder = tmp_path / model / f"sdg_goal_{goal}"
        folder.mkdir(parents=True)
        record = {"text": "t", "sdg_id": goal, "main_topic": "m", "sub_topic": "s", "style": "x", "length": 40}
        (folder / "2024-04-26_12-05_synthetic_data.jsonl").write_text(json.dumps(record) + "\n")
    assert values(readers.read_model_tree(spark, str(tmp_path)), "sdg_id") == [(1,), (2,)]


def test_catalogue_and_lines(spark, tmp_path):
    (tmp_path / "subtopics.json").write_text(
        json.dumps({"1": {"Math": {"Subtopics": ["a", "b"]}}, "2": {"Law": {"Subtopics": []}}}, indent=2)
    )
    (tmp_path / "length.txt").write_text("40\n100\n160\n")
    got = readers.read_subtopics(spark, str(tmp_path / "subtopics.json"))
    assert values(got, "sdg_id", "main_topic", "sub_topic") == [(1, "Math", "a"), (1, "Math", "b")]
    assert values(readers.read_lines(spark, str(tmp_path / "length.txt")), "value") == [("100",), ("160",), ("40",)]


def test_metadata_document(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"p1": {"K": "a\nb"}, "p2": {}}, indent=3))
    got = readers.read_metadata(spark, str(tmp_path / "m.json"))
    assert {r.id: r.meta for r in got.collect()} == {"p1": {"K": "a\nb"}, "p2": {}}


def test_topic_files_skip_excluded_names(spark, tmp_path):
    for name in ("space law.csv", "null_labels_clean.csv", "osdg.csv"):
        (tmp_path / name).write_text(",id,title,abstract,field,sdg_relation\n0,x,t,a,f,0\n")
    assert readers.read_topic_files(spark, str(tmp_path)).count() == 1


def test_topic_files_by_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text(',id,title,abstract,field,sdg_relation\n0,1,t,"two\nlines, ""q""",f,0\n')
    (tmp_path / "b c.csv").write_text("abstract,extra,sdg_relation,id,field,title\nA,e,0,2,f,T\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "d.csv").write_text("\ufeffid,abstract,title,field,sdg_relation\n3,A3,T3,f,0\n")
    got = readers.read_topic_files(spark, str(tmp_path))
    assert values(got, "id", "title", "abstract") == [("1", "t", 'two\nlines, "q"'), ("2", "T", "A"), ("3", "T3", "A3")]
    (tmp_path / "e.csv").write_text("id,title,field,sdg_relation\n4,T,f,0\n")
    with pytest.raises(ValueError, match="abstract"):
        readers.read_topic_files(spark, str(tmp_path))


def test_topic_files_with_broken_rows_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,title,abstract,field,sdg_relation\n1,t,a,f\n")
    with pytest.raises(Exception):
        readers.read_topic_files(spark, str(tmp_path)).collect()
    (tmp_path / "a.csv").write_text("id,title,id,abstract,field,sdg_relation\n")
    with pytest.raises(ValueError, match="two columns"):
        readers.read_topic_files(spark, str(tmp_path))


def test_read_if_exists(spark, tmp_path):
    assert readers.read_if_exists(spark, str(tmp_path / "no"), "id string").count() == 0


def test_cleaned_corpus_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a b", 1, 1), ("", 2, 0)], schemas.CLEANED)
    path = writers.write_corpus(rows, str(tmp_path), True, False)
    assert path.endswith("cleaned_data_with_null.csv")
    assert values(readers.read_cleaned(spark, path), "text_clean") == [("",), ("a b",)]
    assert values(readers.read_cleaned(spark, path, empty_text=False), "text_clean") == [("a b",)]


def test_staged_table_lies_in_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir").rstrip("/")
    staged = staging.stage(spark.range(3), "t")
    assert all(named in f for f in staged.inputFiles()) and staged.count() == 3


def test_a_folder_of_one_machine_is_refused_on_a_cluster():
    from types import SimpleNamespace as Fake

    local = Fake(getUri=lambda: Fake(getScheme=lambda: "file"), getHomeDirectory=lambda: Fake(toString=lambda: "file:/home/u/"))

    def session(master):
        system = Fake(get=lambda conf: local)
        jvm = Fake(org=Fake(apache=Fake(hadoop=Fake(fs=Fake(FileSystem=system)))))
        context = Fake(getCheckpointDir=lambda: None, _jsc=Fake(hadoopConfiguration=lambda: None), _jvm=jvm, master=master)
        return Fake(conf=Fake(get=lambda name, default: default), sparkContext=context)

    for master in ("local", "local[8]"):
        assert staging.shared_dir(session(master)) == "file:/home/u/.labelloom"
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            staging.shared_dir(session(master))


# --- corpus ---------------------------------------------------------------------------


def _sources(spark):
    abstracts = spark.createDataFrame(
        [("1", EN, 1), ("2", DE, 1), ("3", EN + " zero", 0), ("4", EN, None)], schemas.ABSTRACTS
    )
    community = spark.createDataFrame(
        [(EN, 2, 0.9), ("This is the text of the forest", 3, 0.5), (EN, 4, 0.1), ("the zero of the", 0, 1.0)],
        schemas.COMMUNITY,
    )
    null_rows = spark.createDataFrame(
        [("n", "t", EN, "f", 0, 0), ("m", "t", None, "f", 0, 0)], schemas.NULL_CLASS
    )
    synthetic = spark.createDataFrame(
        [("x Web of Science die Studie", 5, "m", "s", "st", 40)], schemas.SYNTHETIC
    )
    return abstracts, community, null_rows, synthetic


def test_two_sources_drop_class_zero(spark):
    abstracts, community, _, _ = _sources(spark)
    got = corpus.harmonise(abstracts, community)
    rows = sorted((str(r.label), r.is_abstract) for r in got.collect())
    assert rows == [("1", 1), ("2", 1), ("3", 0), ("None", 1)]
    assert corpus.harmonise(abstracts, community, threshold=None).count() == 5


def test_four_sources(spark):
    got = corpus.harmonise(*_sources(spark))
    counts = dict(values(got.groupBy("is_abstract").count(), "is_abstract", "count"))
    assert counts == {0: 2, 1: 5, 2: 1}
    assert got.filter("is_abstract = 2").first().text == "die Studie"


def test_corpus_plan_has_no_shuffle(spark):
    plan = corpus.prepare_corpus(*_sources(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


# --- splits -----------------------------------------------------------------------------


@pytest.mark.parametrize("exact", [False, True])
def test_three_way_split(spark, exact):
    rows = spark.range(600).select(
        F.col("id").alias("row_id"),
        (F.col("id") % 3).cast("int").alias("label"),
        (F.col("id") % 2).cast("int").alias("is_abstract"),
        F.lit("t").alias("text_clean"),
    )
    split = splits.three_way_split(rows, exact=exact)
    counts = dict(values(split.groupBy("split").count(), "split", "count"))
    assert sum(counts.values()) == 600 and counts["train"] == 417
    if exact:
        assert counts == {"train": 417, "validation": 91, "test": 92}
    words = splits.training_columns(splits.with_label_words(split))
    assert {r.label for r in words.select("label").distinct().collect()} == {"zero", "one", "two"}


def test_split_plan_does_not_shuffle_the_rows(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    from labelloom.operators.sampling import stratified_split

    plan = stratified_split(documents, "lang", "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Sort" not in plan


# --- synthetic data -----------------------------------------------------------------------


def _catalogues(spark):
    subtopics = spark.createDataFrame(
        [(1, "Math", "a"), (1, "Math", "b"), (1, "Law", "c"), (2, "Art", "d")],
        "sdg_id int, main_topic string, sub_topic string",
    )
    styles = spark.createDataFrame([("plain",), ("dense",)], "value string")
    lengths = spark.createDataFrame([("40",), ("100",), ("160",)], "value string")
    return subtopics, styles, lengths


def test_draws(spark):
    plan = spark.createDataFrame([(1, 25_000), (2, 0), (3, 5)], "sdg_id int, n int")
    draws = synthesis.draw_attributes(plan, *_catalogues(spark)).cache()
    assert draws.count() == 25_000  # class 2 is planned 0 times, class 3 has no topics
    assert draws.select("draw_no").distinct().count() == 25_000
    shares = dict(values(draws.groupBy("sub_topic").count(), "sub_topic", "count"))
    assert abs(shares["c"] - 12_500) < 600 and abs(shares["a"] - 6_250) < 600
    again = synthesis.draw_attributes(plan.repartition(5), *_catalogues(spark))
    assert draws.exceptAll(again).count() == 0


def test_prompt_text(spark):
    row = spark.createDataFrame(
        [("no_sdg", "Math", "sets", 40, "plain"), ("Zero Hunger", "Law", "soil", 100, "dense")],
        "goal string, main_topic string, sub_topic string, length int, style string",
    ).select(synthesis.prompt_text(*[F.col(c) for c in ("goal", "main_topic", "sub_topic", "length", "style")]))
    first, second = [r[0] for r in row.collect()]
    assert "should not be related to any UN SDG goal" in first
    assert "between 40 words and 100 words" in first
    assert "the UN SDG goal of Zero Hunger but do not mention" in second
    assert "abstract of a Law paper" in second and "focus on 'soil'" in second and "style of the paper should be 'dense'" in second


def _prompts(spark):
    plan = spark.createDataFrame([(1, 45)], "sdg_id int, n int")
    goals = spark.createDataFrame([(1, "No Poverty")], "sdg_id int, description string")
    return synthesis.plan_prompts(synthesis.draw_attributes(plan, *_catalogues(spark)), goals)


def test_prompts_and_answers(spark, tmp_path):
    prompts = _prompts(spark).cache()
    sizes = dict(values(prompts.groupBy("batch_id").count(), "batch_id", "count"))
    assert sizes == {0: 20, 1: 20, 2: 5}
    message = prompts.first().messages
    assert message[0].role == "user" and message[0].content.strip().startswith("Write an abstract")
    answers = spark.createDataFrame(
        [("1-1", "Abstract: Low-income homes"), ("1-2", "I'm sorry"), ("9-9", "stray")], schemas.RESPONSES
    )
    records, missing = synthesis.ingest_responses(prompts, answers)
    assert values(records, "text", "sdg_id") == [(": Low income homes", 1)]
    assert missing.count() == 43
    out = str(tmp_path / "out")
    for _ in range(2):
        writers.append_generated(records, out, "meta-llama/Llama-3-70b-chat-hf", "2024-04-26_12-05")
    assert readers.read_generated(spark, out, "llama-3-70b").count() == 2
    writers.append_generated(records, out, "meta-llama/Llama-3-70b-chat-hf", "2024-04-26_12-05", replace_run=True)
    got = readers.read_generated(spark, out)
    assert values(got, "text", "model", "sdg_goal") == [(": Low income homes", "llama-3-70b", 1)]


def test_landed_answers_are_taken_once(spark, tmp_path):
    landed, out, checkpoint = (str(tmp_path / n) for n in ("landed", "out", "state"))
    (tmp_path / "landed").mkdir()
    prompts = staging.stage(_prompts(spark), "prompts")

    def land(name, prompt_id):
        (tmp_path / "landed" / name).write_text(json.dumps({"prompt_id": prompt_id, "message": "text"}) + "\n")

    def run():
        landing.ingest_landed(spark, prompts, landed, out, "gpt-4-turbo", checkpoint).awaitTermination()
        return readers.read_generated(spark, out, "gpt-4-turbo").count()

    land("a.jsonl", "1-1")
    assert run() == 1
    assert run() == 1
    land("b.jsonl", "1-2")
    assert run() == 2


def test_ledger_of_attempts(spark, tmp_path):
    path = str(tmp_path / "ledger")
    prompts = spark.createDataFrame([(str(k),) for k in range(6)], "prompt_id string")
    assert attempts.open_prompts(prompts, attempts.read_ledger(spark, path)).count() == 6
    answers = [
        [("0", "text"), ("0", "another"), ("1", "I'm sorry"), ("x", "stray")], [("2", None)], [("3", "text")], [("4", "late")],
    ]
    for number, said in enumerate(answers[:3]):
        sent = staging.stage(attempts.open_prompts(prompts, attempts.read_ledger(spark, path)), "sent")
        found = attempts.outcomes(sent, spark.createDataFrame(said, schemas.RESPONSES))
        attempts.record(spark, path, f"run-{number}", found)
    ledger = attempts.read_ledger(spark, path)
    rows = values(ledger, "prompt_id", "attempt", "outcome", "run")
    assert rows == sorted([
        ("0", 1, "answered", "run-0"), ("1", 1, "refused", "run-0"),
        *[(k, 1, "missing", "run-0") for k in "2345"],
        ("2", 2, "answered", "run-1"), *[(k, 2, "missing", "run-1") for k in "345"],
        ("3", 3, "answered", "run-2"), *[(k, 3, "missing", "run-2") for k in "45"],
    ])
    assert attempts.open_prompts(prompts, ledger).count() == 0
    assert values(attempts.lost_prompts(ledger), "prompt_id") == [("4",), ("5",)]
    assert values(attempts.open_prompts(prompts, ledger, most=4), "prompt_id") == [("4",), ("5",)]
    # An earlier run written again has the numbers it had.
    again = ledger.filter("run = 'run-1'").select("prompt_id", "outcome")
    attempts.record(spark, path, "run-1", staging.stage(again, "again"))
    assert values(attempts.read_ledger(spark, path), "prompt_id", "attempt", "outcome", "run") == rows


def test_stream_writes_the_ledger(spark, tmp_path):
    landed, out, checkpoint, ledger = (str(tmp_path / n) for n in ("landed", "out", "state", "ledger"))
    (tmp_path / "landed").mkdir()
    prompts = staging.stage(_prompts(spark), "prompts")

    def run(name, *answers):
        lines = [json.dumps({"prompt_id": p, "message": m}) for p, m in answers]
        (tmp_path / "landed" / name).write_text("\n".join(lines) + "\n")
        landing.ingest_landed(spark, prompts, landed, out, "gpt-4-turbo", checkpoint, ledger).awaitTermination()

    run("a.jsonl", ("1-1", "text"), ("1-2", "I apologize"), ("9-9", "stray"))
    first = values(attempts.read_ledger(spark, ledger), "prompt_id", "attempt", "outcome", "run")
    assert first == [("1-1", 1, "answered", "batch-00000000"), ("1-2", 1, "refused", "batch-00000000")]
    # The micro-batch again, as after a failure between its writes and the checkpoint.
    again = spark.createDataFrame([("1-1", "text"), ("1-2", "I apologize"), ("9-9", "stray")], schemas.RESPONSES)
    sent = prompts.join(again.select("prompt_id"), "prompt_id", "left_semi")
    attempts.record(spark, ledger, "batch-00000000", attempts.outcomes(sent, again))
    assert values(attempts.read_ledger(spark, ledger), "prompt_id", "attempt", "outcome", "run") == first
    landing.close_round(spark, prompts, ledger, "batch-00000000-end")
    rows = attempts.read_ledger(spark, ledger)
    assert rows.filter("outcome = 'missing' and attempt = 1").count() == 43
    assert attempts.open_prompts(prompts, rows).count() == 43
    run("b.jsonl", ("1-3", "text"))
    late = attempts.read_ledger(spark, ledger).filter("prompt_id = '1-3'")
    assert values(late, "attempt", "outcome") == [(1, "missing"), (2, "answered")]


# --- published folders ------------------------------------------------------------------------


def test_publish_under_the_same_name(spark, tmp_path):
    folder = str(tmp_path / "set")
    assert publish.current_version(spark, folder) is None
    with pytest.raises(FileNotFoundError):
        publish.current_path(spark, folder)
    publish.publish(spark.createDataFrame([(1, "a"), (2, "b")], "id int, label string"), folder)
    reader = spark.read.parquet(publish.current_path(spark, folder))
    publish.rewrite(spark, folder, lambda df: df.withColumn("label", F.upper("label")))
    assert values(spark.read.parquet(publish.current_path(spark, folder)), "label") == [("A",), ("B",)]
    # A plan made before the swap stays with its version.
    assert values(reader, "label") == [("a",), ("b",)]


def test_a_failed_publication_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "set")
    publish.publish(spark.range(3), folder)
    before = publish.current_version(spark, folder)
    broken = spark.range(3).select(F.raise_error(F.lit("half way")).alias("id"))
    with pytest.raises(Exception, match="half way"):
        publish.publish(broken, folder)

    def half(df, path):
        df.write.parquet(path)
        raise RuntimeError("before the swap")

    with pytest.raises(RuntimeError):
        publish.rewrite(spark, folder, lambda df: df, write=half)
    assert publish.current_version(spark, folder) == before
    assert spark.read.parquet(publish.current_path(spark, folder)).count() == 3


# --- null class ------------------------------------------------------------------------------


def test_null_class(spark):
    hits = spark.createDataFrame(
        [
            ("t", 1, "a", "x", 2020, "abs", ["m", "n"]),
            ("t", 2, "b", "x", 2020, None, None),
            ("t", 3, "c", "x", 2020, "abs", None),
            ("u", 1, "a", "x", 2020, "abs", ["m", "n"]),
        ],
        schemas.SEARCH_HITS,
    )
    got = null_class.null_class(null_class.topic_rows(hits))
    assert sorted((r.id, str(r.field), r.sdg_label) for r in got.collect()) == [("a", "m;n", 0), ("c", "None", 0)]
    assert null_class.topic_rows(hits, cap=1).count() == 2


# --- classifier --------------------------------------------------------------------------------


def test_classifier_learns_and_reloads(spark, tmp_path):
    from pyspark.ml import PipelineModel

    rows = spark.createDataFrame(
        [("wheat soil crop", 2), ("school pupil class", 4)] * 20 + [("crop field", 2), ("pupil", 4)],
        "text_clean string, label int",
    )
    model = classifier.train(rows, features=256, iterations=10)
    model.write().overwrite().save(str(tmp_path / "model"))
    scored = classifier.score(PipelineModel.load(str(tmp_path / "model")), rows)
    assert classifier.evaluate(scored).first().accuracy == 1.0
    fresh = spark.createDataFrame([("soil wheat",)], "text_clean string")
    assert classifier.score(model, fresh).first().prediction == "2"


def _plain_epochs(rows, held, labels, epochs, batches, rate, warm_up, features):
    """The same training with dense matrices: (weights, accuracy) after every epoch."""

    def matrix(listed):
        x = np.zeros((len(listed), features + 1))
        for k, r in enumerate(listed):
            for f in r.features:
                x[k, f] += 1 / np.sqrt(len(r.features))
            x[k, -1] = 1
        return x

    w, out, t, steps = np.zeros((features + 1, len(labels))), [], 0, epochs * batches
    rising = max(int(steps * warm_up), 1)
    for _ in range(epochs):
        for b in range(batches):
            part = [r for r in rows if r.batch == b]
            if part:
                x, y = matrix(part), np.eye(len(labels))[[labels.index(r.label) for r in part]]
                p = np.exp(x @ w)
                p /= p.sum(axis=1, keepdims=True)
                w = w - rate * min((t + 1) / rising, (steps - t) / (steps - rising)) * x.T @ (p - y) / len(part)
            t += 1
        guess = (matrix(held) @ w).argmax(axis=1)
        out.append((w, np.mean([labels[g] == r.label for g, r in zip(guess, held)])))
    return out


def test_epochs_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(classifier, "MOST_WORDS", 20)
    words = ["soil", "wheat", "pupil", "class", "river", "law", "field"]
    rows = [(" ".join(words[(k * j) % 7] for j in range(k % 6)), ("a", "b", "c")[k % 3] if k % 10 else None) for k in range(90)]
    df = spark.createDataFrame(rows, "text_clean string, label string").repartition(3)
    part = spark.createDataFrame(rows[:60], "text_clean string, label string").repartition(2)
    given = dict(epochs=3, batches=4, rate=1.5, warm_up=0.2, features=32)
    model = classifier.train_epochs(part, df, **given)
    kept = []
    monkeypatch.setattr(classifier, "stage", lambda frame, name: kept.append(frame) or frame)
    classifier.train_epochs(part, df, **(given | {"epochs": 0}))
    train_rows, held = (frame.collect() for frame in kept)
    expected = _plain_epochs(train_rows, held, ["a", "b", "c"], **given)
    assert [h[1] for h in model.history] == pytest.approx([a for _, a in expected])
    assert np.abs(model.weights - expected[model.best - 1][0]).max() < 1e-9
    scores = [(f1, accuracy) for _, accuracy, f1 in model.history]
    assert model.best == scores.index(max(scores)) + 1
    found = classifier.score_epochs(model, df.withColumn("id", F.monotonically_increasing_id()), "id")
    assert found.count() == 90 and {r.prediction for r in found.collect()} <= {"a", "b", "c"}


def test_epochs_without_rows(spark):
    empty = spark.createDataFrame([("x", None)], "text_clean string, label string")
    model = classifier.train_epochs(empty, empty, epochs=2, batches=2, features=8)
    assert (model.labels, model.history, model.best) == ([], [], 0)
    assert classifier.score_epochs(model, empty.withColumn("id", F.lit(1)), "id").first().prediction is None


def test_step_rates():
    assert classifier.step_rates(10, 1.0, 0.2) == pytest.approx([0.5, 1.0, 1.0, 0.875, 0.75, 0.625, 0.5, 0.375, 0.25, 0.125])


def test_fixed_values_are_complete():
    assert len(fixed.NUMBER_WORDS) == len(fixed.GOAL_NAMES) == 18


def test_pages_of_one_file_are_spread(spark, tmp_path):
    """One small file is one split; the pages made of its rows are many times as much work."""
    c = F.col("id")
    customers = spark.range(12_000).select(
        c.alias("c_custkey"), F.lit("n").alias("c_name"), F.lit("s").alias("c_mktsegment"), F.lit(1).alias("c_nationkey")
    )
    customers.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    part = spark.range(12_000).select(c.alias("p_partkey"), *[F.lit("a").alias(f"p_{n}") for n in ("name", "brand", "type")], F.lit(1).alias("p_size"))
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for pages in (analysis._metadata_pages(spark, str(tmp_path)), analysis._table_pages(spark, str(tmp_path))):
        sizes = [r["count"] for r in pages.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 3 and max(sizes) < 5_000


def test_cells_are_made_once(spark):
    """A filter on key and value does not make the cells a second time, nor does decoding their tags."""
    pages = spark.createDataFrame([("p", "x")], "id string, html string")
    plan = papers.valid_entries(papers.metadata_entries(pages))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<br\\s*/?>") == 2
