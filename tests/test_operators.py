"""Operators on tiny hand-written frames."""

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from labelloom import fixed
from labelloom.functions import html
from labelloom.operators import (
    batching,
    bloom,
    categories,
    dedup,
    filters,
    languages,
    lookup,
    metrics,
    ranking,
    sampling,
    sentences,
    targets,
    vocabulary,
)
from labelloom.plans import papers
from labelloom.plans import targets as target_plans


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# --- filters -------------------------------------------------------------------------


def test_min_agreement(spark):
    df = spark.createDataFrame([(0.3,), (0.5,), (0.9,)], "agreement double")
    assert values(filters.min_agreement(df), "agreement") == [(0.5,), (0.9,)]
    assert filters.min_agreement(df, None).count() == 3


def test_exclude_class_keeps_nulls(spark):
    df = spark.createDataFrame([(0,), (1,), (None,)], "label int")
    assert {r.label for r in filters.exclude_class(df).collect()} == {1, None}


def test_refusals(spark):
    df = spark.createDataFrame([("I'm sorry",), ("Sorry",), ("an AI language model",)], "message string")
    assert values(filters.drop_refusals(df), "message") == [("Sorry",)]


# --- lookups --------------------------------------------------------------------------


def test_first_match_wins(spark):
    left = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    right = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 5, "only")], "id string, n int, v string")
    assert values(lookup.first_match(left, right, "id", ["n"], ["v"]), "id", "v") == [("a", "early"), ("b", "only")]
    assert values(lookup.unmatched(left, right, "id"), "id") == [("c",)]


def test_skip_named_by_suffix_and_exactly(spark):
    topics = spark.createDataFrame([("animal behavior",), ("space law",)], "topic string")
    files = spark.createDataFrame(
        [("wildlife photography and animal behavior.csv",), ("x",), ("",)], "name string"
    )
    assert values(lookup.skip_named(topics, files, exact=False), "topic") == [("space law",)]
    assert lookup.skip_named(topics, files).count() == 2


def test_suffixes_are_cut_by_length_and_filtered(spark):
    topics = spark.createDataFrame([("a",), ("long topic",), ("",), (None,)], "topic string")
    files = spark.createDataFrame([("x a.csv",), ("no long topic.cs",), (None,), ("csv",)], "name string")
    assert values(lookup.skip_named(topics.filter("topic is not null"), files, exact=False), "topic") == [("long topic",)]
    assert lookup.skip_named(topics.limit(0), files, exact=False).count() == 0
    assert lookup.skip_named(topics, files.limit(0), exact=False).count() == 4


@pytest.mark.parametrize("most", [1 << 10, 1 << 21])
def test_bloom_filter_loses_nothing(spark, monkeypatch, most):
    monkeypatch.setattr(bloom, "MOST_BITS", most)
    values_in = spark.range(0, 6000, 2).select(F.concat(F.lit("v"), "id").alias("v"))
    found = bloom.build(values_in, "v")
    asked = spark.range(6000).select("id", F.concat(F.lit("v"), "id").alias("v")).filter(found.may_contain(F.col("v")))
    assert asked.filter("id % 2 = 0").count() == 3000
    if most > 1 << 15:
        assert asked.filter("id % 2 = 1").count() < 300


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([(1,)], "n int")
    assert lookup.union_all(a, b, b).count() == 3


def test_plan_versus_actual(spark):
    plan = spark.createDataFrame([(1, 3), (2, 1)], "label int, planned int")
    actual = spark.createDataFrame([(1,), (1,), (9,)], "label int")
    got = lookup.plan_versus_actual(plan, actual, "label")
    assert values(got, "label", "planned", "actual", "missing") == [(1, 3, 2, 1), (2, 1, 0, 1)]


def test_dedup_keeps_smallest_id_and_counts_nulls_equal(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, None), (5, "")], "id int, t string")
    assert values(dedup.distinct_on(df, ["t"], "id"), "id") == [(1,), (2,), (5,)]
    assert dedup.distinct_rows(df.select("t")).count() == 3


# --- sampling -------------------------------------------------------------------------


def test_stratified_quotas(spark):
    counts = spark.createDataFrame([("en", 620), ("fr", 145), ("de", 129), ("es", 106)], "label string, n bigint")
    got = dict(values(sampling.stratified_quotas(counts, "label", "0.3"), "label", "quota"))
    assert got == {"en": 186, "fr": 43, "de": 39, "es": 32}


def test_stratified_quotas_of_huge_classes(spark):
    counts = spark.createDataFrame([("a", 30_000_000_000), ("b", 60_000_000_001)], "label string, n bigint")
    got = dict(values(sampling.stratified_quotas(counts, "label", "0.3"), "label", "quota"))
    assert sum(got.values()) == 27_000_000_001 and got["a"] == 9_000_000_000


@pytest.mark.parametrize("sizes", [[("a", 1), ("b", 50)], [("a", 2), ("b", 2), ("c", 2)]])
def test_stratified_split_rejects_what_cannot_be_split(spark, sizes):
    counts = spark.createDataFrame(sizes, "label string, n bigint")
    with pytest.raises(Exception, match="label"):
        sampling.stratified_quotas(counts, "label", "0.3").collect()


def _corpus(spark, partitions):
    return spark.range(0, 1000, 1, partitions).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 != 0, 0).otherwise((F.col("id") % 7).cast("int")).alias("label"),
        F.when(F.col("id") % 5 == 0, 1).otherwise(F.col("id") % 2 * 2).cast("int").alias("is_abstract"),
    )


def test_rule_based_split_invariants(spark):
    df = _corpus(spark, 3)
    split = sampling.rule_based_split(df).cache()
    assert split.count() == 1000 and split.select("row_id").distinct().count() == 1000
    test = split.filter("split = 'test'")
    labels = df.filter("is_abstract = 1").select("label").distinct().count()
    assert test.filter("is_abstract = 1").select("label").distinct().count() == labels
    assert test.count() == labels + -(-(1000 - labels) * 3 // 10)
    again = sampling.rule_based_split(_corpus(spark, 11))
    assert values(split, "row_id", "split") == values(again, "row_id", "split")


def test_rule_based_split_with_more_guaranteed_rows(spark):
    split = sampling.rule_based_split(_corpus(spark, 4), n=4)
    counts = split.filter("split = 'test' and is_abstract = 1").groupBy("label").count()
    assert counts.filter("count < 4").count() == 0


def test_sample_per_group_is_exact(spark):
    got = sampling.sample_per_group(_corpus(spark, 5), "label", "row_id", n=3)
    assert got.groupBy("label").count().filter("count != 3").count() == 0


def test_exact_split_sizes(spark):
    df = spark.range(101).withColumnRenamed("id", "row_id")
    counts = dict(values(sampling.exact_split(df, "row_id").groupBy("split").count(), "split", "count"))
    assert counts == {"validation": 50, "test": 51}


def test_bucket_split_is_about_half(spark):
    df = spark.range(2000).withColumnRenamed("id", "row_id")
    n = sampling.bucket_split(df, "row_id").filter("split = 'test'").count()
    assert 900 < n < 1100


def test_ordered_position_with_a_hot_group(spark):
    df = spark.range(0, 5000, 1, 7).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise((F.col("id") % 4).cast("string")).alias("g"), (-F.col("id")).alias("o")
    )
    got = ranking.ordered_position(df, ["g"], ["o"]).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.g, []).append((r.o, r.position))
    for rows in groups.values():
        assert [p for _, p in sorted(rows)] == list(range(1, len(rows) + 1))


def test_ordered_position_of_equal_and_null_keys(spark):
    df = spark.range(0, 600, 1, 5).select(
        F.when(F.col("id") % 3 != 0, "g").alias("g"), F.when(F.col("id") % 7 != 0, F.col("id") % 50).alias("o"), F.col("id").alias("v")
    )
    got = ranking.ordered_position(df, ["g"], ["o"])
    assert got.columns == ["g", "o", "v", "position"] and got.count() == 600
    groups = {}
    for r in got.collect():
        groups.setdefault(r.g, []).append((r.position, -1 if r.o is None else r.o))
    for rows in groups.values():
        rows.sort()
        assert [p for p, _ in rows] == list(range(1, len(rows) + 1))
        assert [o for _, o in rows] == sorted(o for _, o in rows)
    assert ranking.ordered_position(df.limit(0), ["g"], ["o"]).count() == 0


def test_ordered_position_sorts_keys_only(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = ranking.ordered_position(documents, ["lang"], ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Window" not in plan


def test_first_per_group_with_a_hot_group(spark):
    df = spark.range(0, 5000, 1, 9).select(F.lit("hot").alias("g"), "id")
    got = ranking.first_per_group(df, ["g"], ["-id"], 3)
    assert values(got, "id") == [(4997,), (4998,), (4999,)]


@pytest.mark.parametrize("k", [1, 7, 400, 50_000])
def test_selection_in_hot_groups(spark, monkeypatch, k):
    """Many rounds of narrowing, order columns with nulls, falling and rising, null groups."""
    monkeypatch.setattr(ranking, "RANKED", 500)
    group = F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, F.concat(F.lit("g"), F.col("id") % 3))
    a = F.when(F.col("id") % 11 != 0, F.col("id") * 7919 % 1000)
    df = spark.range(0, 90_000, 1, 8).select(group.alias("g"), a.alias("a"), F.concat(F.lit("s"), "id").alias("s"), F.col("id").alias("extra"))
    got = ranking.first_per_group(df, ["g"], ["-a", "s"], k)
    window = Window.partitionBy("g").orderBy(F.col("a").desc(), "s")
    expected = df.withColumn("n", F.row_number().over(window)).filter(F.col("n") <= k).drop("n")
    assert got.columns == df.columns and got.count() == expected.count()
    assert got.exceptAll(expected).count() == 0


def test_selection_keeps_ties_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RANKED", 50)
    df = spark.range(400).select(F.lit(1).alias("g"), F.when(F.col("id") < 10, F.col("id")).otherwise(10).alias("o"), "id")
    assert ranking.first_per_group(df, ["g"], ["o"], 5).count() == 5
    assert ranking.first_per_group(df, ["g"], ["o"], 20).count() == 400
    assert ranking.first_per_group(df.limit(0), ["g"], ["o"], 5).count() == 0


def test_selection_neither_sorts_nor_shuffles_the_rows(spark):
    df = spark.range(10_000).select((F.col("id") % 3).alias("g"), "id", F.lit("text").alias("text"))
    plan = ranking.first_per_group(df, ["g"], ["id"], 30)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan and "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_positions_move_rows_once(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = sampling.shuffle_rows(documents, "doc_id")
        plan = shuffled._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    text_side = plan.split("Inner", 1)[1].split("Window [sum")[0]
    assert text_side.split("FileScan")[0].count("Exchange") == 1


def test_batches(spark):
    df = spark.range(45).select(F.lit("a").alias("g"), "id")
    packed = batching.collect_batches(batching.number_batches(df, ["g"], ["id"]), ["g"], ["id"], "id")
    assert values(packed.select(F.size("items").alias("n"), "batch_id"), "batch_id", "n") == [(0, 20), (1, 20), (2, 5)]
    assert packed.filter("batch_id = 1").first()["items"] == list(range(20, 40))


# --- categories -------------------------------------------------------------------------


def test_papers_per_category_modes(spark):
    df = spark.createDataFrame([(1, "A > x\nB > y\nA > z"), (1, ""), (1, None)], "label int, c string")
    assert values(categories.papers_per_category(df, "label", "c", "first"), "parent", "papers") == [("A", 1)]
    assert values(categories.papers_per_category(df, "label", "c"), "parent", "papers") == [("A", 1), ("B", 1)]
    with pytest.raises(ValueError):
        categories.papers_per_category(df, "label", "c", "some")


def test_path_nodes_round_trip(spark):
    paths = [(0, "A > B > C"), (0, "A > D"), (1, "A")]
    nodes = categories.path_nodes(spark.createDataFrame(paths, "label int, path string"), "label")
    listed = [list(r.path) for r in nodes.filter("label = 0").orderBy("path").collect()]
    assert listed == [["A"], ["A", "B"], ["A", "B", "C"], ["A", "D"]]
    assert values(categories.leaf_paths(nodes, "label"), "label", "path") == sorted(paths)
    lines = [r.line for r in categories.tree_listing(nodes, "label").filter("label = 0").collect()]
    assert lines == ["A", "---B", "------C", "---D"]
    trees = {r.label: json.loads(r.tree) for r in papers.tree_documents(nodes, "label").collect()}
    assert trees == {0: {"A": {"B": {"C": {}}, "D": {}}}, 1: {"A": {}}}


def test_trees_of_any_depth(spark):
    deep = " > ".join("ABCDEFG")
    nodes = categories.path_nodes(spark.createDataFrame([(0, deep), (1, "X")], "label int, path string"), "label")
    trees = {r.label: json.loads(r.tree) for r in papers.tree_documents(nodes, "label").collect()}
    assert trees == {0: {"A": {"B": {"C": {"D": {"E": {"F": {"G": {}}}}}}}}, 1: {"X": {}}}
    assert papers.tree_documents(nodes.limit(0), "label").count() == 0


def test_tree_documents_quote_names(spark):
    nodes = categories.path_nodes(spark.createDataFrame([(0, 'a "b" > c\\d')], "label int, path string"), "label")
    assert json.loads(papers.tree_documents(nodes, "label").first().tree) == {'a "b"': {"c\\d": {}}}


def test_category_analysis(spark):
    meta = spark.createDataFrame(
        [
            ("p1", {fixed.CATEGORY_KEYS[0]: "F > I\nG", fixed.CATEGORY_KEYS[1]: "600 > 610", "Other": "z"}),
            ("p2", {"Other": "z"}),
            ("p3", {}),
        ],
        "id string, meta map<string,string>",
    )
    labels = spark.createDataFrame(
        [("p1", 3, 0), ("p1", 4, 1), ("p2", 3, 2)], "ID string, SDG int, row_no int"
    )
    found, missing = papers.label_papers(meta, labels)
    assert values(found, "id", "SDG") == [("p1", 3), ("p2", 3)]
    assert values(missing, "id") == [("p3",)]
    tree = papers.category_tree(found)
    assert values(tree.select(F.array_join("path", "/").alias("p")), "p") == [("600",), ("600/610",), ("F",), ("F/I",), ("G",)]
    assert values(papers.faculty_counts(found), "SDG", "parent", "papers") == [(3, "F", 1), (3, "G", 1)]


# --- spanned tables ------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [1, 2, 1000])
def test_targets(spark, chunk):
    rows = spark.createDataFrame(
        [
            (1, 2, ["lost", "c"]),
            (1, 3, [" T1 ", "i1", "c"]),
            (1, 4, ["i2", "c"]),
            (1, 5, ["ignored"]),
            (1, 6, ["T2", "i3", "c"]),
            (1, 7, ["T1", "i4", "c"]),
            (1, 8, ["i5", "c"]),
            (2, 2, ["T1", "i6", "c"]),
        ],
        "goal int, row_no int, cells array<string>",
    )
    filled = targets.fill_targets(rows, chunk=chunk)
    assert values(targets.rejected_rows(filled), "indicator") == [("lost",)]
    valid = targets.indicators(filled)
    assert values(valid, "goal", "target", "indicator") == [
        (1, "T1", "i4"), (1, "T1", "i5"), (1, "T2", "i3"), (2, "T1", "i6"),
    ]
    lists = target_plans.target_documents(valid)
    assert values(lists, "goal", "target", "indicators") == [
        (1, "T1", ["i4", "i5"]), (1, "T2", ["i3"]), (2, "T1", ["i6"]),
    ]


def test_wiki_tables(spark):
    html = (
        "<table class='wikitable'><tr><th>T</th></tr>"
        "<tr><td>T1<br>more</td><td>i &amp; 1</td><td>c</td></tr><tr><td>i2</td><td>c</td></tr></table>"
        "<table class='x'><tr><td>no</td></tr><tr><td>no</td></tr></table>"
        '<TABLE border=1 class="a wikitable"><TR><TH>T</TH></TR><TR><TD>T9</TD><TD>i9</TD><TD>c</TD></TR></TABLE>'
    )
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    rows = target_plans.table_rows(pages)
    valid, rejected = target_plans.goal_targets(rows)
    assert rejected.count() == 0
    assert values(valid, "goal", "target", "indicator") == [
        (1, "T1\nmore", "i & 1"), (1, "T1\nmore", "i2"), (2, "T9", "i9"),
    ]


def test_pages_do_not_mix(spark):
    def page(name):
        return (
            f"<table class='wikitable'><tr><th>T<tr><td>{name}<td>i1<td>c<tr><td>i2<td>c"
            "<tr><td>x<table><tr><td>in</table><td>c</table>"
        )

    pages = spark.createDataFrame([(1, page("A")), (2, page("B"))], "page_id int, html string")
    valid, rejected = target_plans.goal_targets(target_plans.table_rows(pages))
    assert rejected.count() == 0
    assert values(valid, "page_id", "target", "indicator") == [
        (1, "A", "i1"), (1, "A", "i2"), (1, "A", "x\n\nin"), (2, "B", "i1"), (2, "B", "i2"), (2, "B", "x\n\nin"),
    ]


def test_entities(spark):
    df = spark.createDataFrame([("&amp;lt; &eacute;&#233;&#xE9; &nope; & &#0; A&#128512;",)], "v string")
    assert df.select(html.decode_entities(df.v)).first()[0] == "&lt; ééé &nope; & &#0; A😀"


def test_metadata_block(spark):
    html = (
        '<div class="ep_block"><table><tr><th>K:</th><td>a<br/>b</td></tr><tr><td>no key</td></tr>'
        "<tr><th>K:</th><td>last</td><td>second</td></tr></table></div>"
        '<div class="ep_block"><table><tr><th>Z</th><td>other block</td></tr></table></div>'
    )
    entries = papers.metadata_entries(spark.createDataFrame([("p", html)], "id string, html string"))
    assert values(papers.valid_entries(entries), "key", "value") == [("K:", "last")]
    assert papers.rejected_entries(entries).count() == 1


# --- metrics -----------------------------------------------------------------------------


def test_metrics_small(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "label int, prediction int")
    row = metrics.report(df).first()
    assert row.accuracy == pytest.approx(2 / 3) and row.weighted_f1 == pytest.approx(2 / 3)
    assert metrics.accuracy(df).first()[0] == pytest.approx(2 / 3)


def test_metrics_agree_with_spark_ml(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    df = spark.range(300).select(
        (F.col("id") % 4).cast("double").alias("label"), (F.col("id") * 7 % 5).cast("double").alias("prediction")
    )
    row = metrics.report(df).first()
    for name, value in (("accuracy", row.accuracy), ("weightedFMeasure", row.weighted_f1)):
        evaluator = MulticlassClassificationEvaluator(
            labelCol="label", predictionCol="prediction", metricName=name
        )
        assert evaluator.evaluate(df) == pytest.approx(value)


# --- languages and vocabulary ----------------------------------------------------------------


def test_learned_profiles_detect(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    split = sampling.stratified_split(documents, "lang", "doc_id").cache()
    profiles = languages.learn_profiles(split.filter("split = 'train'"))
    held_out = split.filter("split = 'test'")
    found = languages.detect_by_join(held_out, profiles, "doc_id").join(held_out, "doc_id")
    assert found.count() == held_out.count()
    assert found.agg(F.avg((F.col("lang") == F.col("language")).cast("int"))).first()[0] > 0.9


def test_texts_without_known_tokens(spark):
    rows = spark.createDataFrame([(1, "zzz"), (2, None), (3, "the")], "id int, text string")
    profiles = spark.createDataFrame([("en", "the", 5)], "lang string, token string, weight bigint")
    found = languages.detect_by_join(rows, profiles, "id")
    assert values(found, "id", "language") == [(1, "error"), (2, "error"), (3, "en")]


SENTENCES = {
    "en": "the people of this city have asked for more time because the work was not done",
    "de": "die Menschen in dieser Stadt haben um mehr Zeit gebeten weil die Arbeit nicht fertig war",
    "fr": "les gens de cette ville ont besoin de plus de temps parce que le travail est encore long",
    "es": "la gente de esta ciudad pide más tiempo porque el trabajo todavía no está terminado",
    "nl": "de mensen van deze stad hebben om meer tijd gevraagd omdat het werk nog niet klaar is",
    "it": "la gente di questa città ha chiesto più tempo perché il lavoro non è ancora finito",
    "pt": "as pessoas desta cidade pediram mais tempo porque o trabalho ainda não foi terminado",
}


def test_open_set_of_languages(spark):
    known = [(lang, SENTENCES[lang]) for lang in ("en", "de", "fr", "es")]
    learned = languages.learn_letters(spark.createDataFrame(known * 3, "lang string, text string"))
    rows = [(k, lang, text) for k, (lang, text) in enumerate(SENTENCES.items())] + [(90, None, None), (91, None, ""), (92, None, "123 !")]
    asked = spark.createDataFrame(rows, "id int, lang string, text string")
    found = {r.id: r.language for r in languages.detect_open_set(asked, learned, "id").collect()}
    assert [found[k] for k in range(7)] == ["en", "de", "fr", "es", "error", "error", "error"]
    assert [found[k] for k in (90, 91, 92)] == ["error"] * 3
    none = languages.learn_letters(spark.createDataFrame([(None, "a")], "lang string, text string"))
    assert {r.language for r in languages.detect_open_set(asked, none, "id").collect()} == {"error"}


def test_other_languages_are_not_english_or_spanish(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = languages.learn_letters(documents)
    asked = spark.createDataFrame([(lang, SENTENCES[lang]) for lang in ("nl", "it", "pt")], "id string, text string")
    found = {r.id: r.language for r in languages.detect_open_set(asked, learned, "id").collect()}
    assert not {"en", "es"} & set(found.values())


def test_open_set_accuracy(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    split = sampling.stratified_split(documents, "lang", "doc_id").cache()
    learned = languages.learn_letters(split.filter("split = 'train'"))
    held_out = split.filter("split = 'test'")
    found = languages.detect_open_set(held_out, learned, "doc_id").join(held_out, "doc_id")
    assert found.count() == held_out.count()
    assert found.agg(F.avg((F.col("lang") == F.col("language")).cast("int"))).first()[0] > 0.9


def test_margin_and_share(spark):
    rows = [("a", "abcabc"), ("b", "abcabd")]
    learned = languages.learn_letters(spark.createDataFrame(rows, "lang string, text string"))
    asked = spark.createDataFrame([(1, "abc")], "id int, text string")
    assert languages.detect_open_set(asked, learned, "id", margin=0).first().language == "a"
    assert languages.detect_open_set(asked, learned, "id", margin=5_000).first().language == "error"
    far = spark.createDataFrame([(1, "xyz")], "id int, text string")
    assert languages.detect_open_set(far, learned, "id", margin=0).first().language == "error"


def test_abbreviations_are_learned(spark):
    texts = [f"He met Approx. {k} people. The people were there, i.e. here. People of the town said no etc. and left." for k in range(30)]
    texts += ["The end. A people. We go. No people.", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    scores = {r.token: r.score for r in sentences.abbreviation_scores(df).collect()}
    assert scores["i.e"] > scores["etc"] > scores["approx"] > 0 and scores["people"] < sentences.LEAST_SCORE
    learned = sentences.learn_abbreviations(df)
    assert {"i.e", "etc"} <= {r.token for r in learned.collect()} and not learned.filter("token = 'people'").count()
    assert sentences.abbreviation_scores(spark.createDataFrame([("no stops",)], "text string")).count() == 0
    assert sentences.abbreviation_scores(df.limit(0)).count() == 0


def test_abbreviation_scores_follow_the_formula(spark):
    import math

    df = spark.createDataFrame([("ab. x y z ab ab. end.",)], "text string")
    row = sentences.abbreviation_scores(df).filter("token = 'ab'").first()
    p, k, rest = 3 / 7, 2, 1
    likelihood = lambda q: k * math.log(q) + rest * math.log(1 - q)
    expected = -2 * (likelihood(p) - likelihood(0.99)) * math.exp(-2) / 2**rest
    assert (row.with_stop, row.without_stop) == (k, rest) and row.score == pytest.approx(expected, abs=1e-6)


def test_tokens_under_a_learned_table(spark):
    rows = [(1, "see approx. five. then etc. go p. two dr. end approx."), (2, "no stop"), (3, ""), (4, "approx. x")]
    df = spark.createDataFrame(rows, "id int, text string")
    table = spark.createDataFrame([("approx", 1.0), ("etc", 2.0), ("etc", 2.5)], "token string, score double")
    expected = {
        1: ["see", "five", "then", "go", "two", "dr", "end", "approx"], 2: ["no", "stop"], 3: [], 4: ["x"],
    }
    for most in (10, 1, 0):
        found = sentences.tokens_with(df, table, "id", most_literals=most)
        assert found.columns == ["id", "text", "tokens"]
        assert {r.id: r.tokens for r in found.collect()} == expected
    plan = sentences.tokens_with(df, table, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    bare = sentences.tokens_with(df, table.limit(0), "id").filter("id = 4").first().tokens
    assert bare == ["approx", "x"]


def test_vocabulary_lemmas(spark):
    words = ["species", "classes", "assess", "xyzs", "men", "wolves"]
    vocabulary_words = ["species", "specie", "class", "man", "wolf"]
    tokens = spark.createDataFrame([(w,) for w in words], "token string")
    known = spark.createDataFrame([(w,) for w in vocabulary_words], "word string")
    lemmas = vocabulary.lemma_table(tokens, known)
    assert dict(values(lemmas, "token", "lemma")) == {
        "species": "specie", "classes": "class", "assess": "assess", "xyzs": "xyzs", "men": "man", "wolves": "wolf",
    }
    rows = spark.createDataFrame([(1, ["men", "see", "wolves"]), (2, [])], "id int, tokens array<string>")
    applied = vocabulary.apply_lemmas(rows, lemmas, "id", "tokens")
    assert values(applied, "id", "text_clean") == [(1, "man see wolf"), (2, "")]


def test_lemma_rounds_and_exceptions(spark):
    def lemma(words, known, exceptions=None):
        tokens = spark.createDataFrame([(w,) for w in words], "token string")
        listed = spark.createDataFrame([(w,) for w in known], "word string")
        table = exceptions and spark.createDataFrame(exceptions, "token string, lemma string")
        return dict(values(vocabulary.lemma_table(tokens, listed, table or None), "token", "lemma"))

    # Without an entry for itself or its first form a word is cut again.
    assert lemma(["less", "s", "sss"], ["le"]) == {"less": "le", "s": "s", "sss": "sss"}
    assert lemma(["less"], ["le", "les"]) == {"less": "les"}
    assert lemma(["less"], ["le", "less"]) == {"less": "less"}
    assert lemma(["children", "wolveses"], ["child", "wolf", "wolve"]) == {"children": "children", "wolveses": "wolf"}
    irregular = [("children", "child"), ("axes", "ax"), ("axes", "axis"), ("geese", "goose")]
    assert lemma(["children", "axes", "geese"], ["child", "ax", "axis", "axe"], irregular) == {
        "children": "child", "axes": "ax", "geese": "geese",
    }
    # Exceptions go first even where a rule would find a shorter word.
    assert lemma(["axes"], ["axis", "ax"], [("axes", "axis")]) == {"axes": "axis"}
    assert lemma(["men"], ["men", "man"]) == {"men": "men"}
    assert lemma([], ["a"]) == {}


@pytest.mark.parametrize("frequent", [0.0, 0.2, 2.0])
def test_lemmas_of_frequent_and_rare_tokens_agree(spark, frequent):
    rows = [(k, ["men", "see", "wolves"] + ["cats"] * (k % 3)) for k in range(30)] + [(99, None), (98, [])]
    df = spark.createDataFrame(rows, "id int, tokens array<string>")
    lemmas = spark.createDataFrame([("men", "man"), ("wolves", "wolf"), ("cats", "cat"), ("see", "see")], "token string, lemma string")
    singular = {"men": "man", "wolves": "wolf", "cats": "cat"}
    expected = sorted((k, " ".join(singular.get(t, t) for t in tokens or [])) for k, tokens in rows)
    assert values(vocabulary.apply_lemmas(df, lemmas, "id", "tokens", frequent), "id", "text_clean") == expected
