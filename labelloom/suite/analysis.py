"""Category paths, spanned tables and landed HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom import fixed
from labelloom.functions.text import process_text
from labelloom.functions.text import truncate_tokens as cut_tokens
from labelloom.operators import batching, categories, sampling, targets
from labelloom.plans import classifier, papers, splits
from labelloom.plans import targets as target_plans
from labelloom.sources.readers import spread
from labelloom.sources.staging import stage
from labelloom.suite.registry import query, sql_key, sql_process_text, table
from labelloom.suite.sampling import sql_stratified

# --- category paths: region > nation > customer segment -----------------------

_PATHS = """paths as (select c_custkey as id, c_nationkey as label,
      r_name || ' > ' || n_name || ' > ' || c_mktsegment || chr(10) || c_mktsegment || ' > ' || r_name
        as categories
      from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
    lines as (select id, label, unnest(string_split(categories, chr(10))) as path from paths)"""


def _papers(spark, sf_dir):
    """Customers as papers, each with two category paths."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation")
    regions = table(spark, sf_dir, "region")
    placed = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(
        regions, F.col("n_regionkey") == F.col("r_regionkey")
    )
    return placed.select(
        F.col("c_custkey").alias("id"),
        F.col("c_nationkey").alias("label"),
        F.concat_ws(
            "\n",
            F.concat_ws(" > ", "r_name", "n_name", "c_mktsegment"),
            F.concat_ws(" > ", "c_mktsegment", "r_name"),
        ).alias("categories"),
    )


def _nodes(spark, sf_dir):
    listed = _papers(spark, sf_dir)
    lines = listed.select("label", F.explode(F.split("categories", "\n")).alias("path"))
    return categories.path_nodes(lines, "label")


@query(
    """select doc_id, lang, source as key, unnest(string_split(text, chr(10))) as line from documents"""
)
def group_lines(spark, sf_dir):
    listed = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.create_map("source", "text").alias("meta")
    )
    return categories.metadata_lines(listed, ["doc_id", "lang"])


@query(
    """select distinct lang, source as key, unnest(string_split(text, chr(10))) as line from documents"""
)
def distinct_lines(spark, sf_dir):
    listed = table(spark, sf_dir, "documents").select(
        "lang", F.create_map("source", "text").alias("meta")
    )
    return categories.distinct_lines(categories.metadata_lines(listed, ["lang"]), "lang")


_NODES = f"""{_PATHS},
    parts as (select distinct label, string_split(path, ' > ') as parts from lines),
    nodes as (select distinct label, parts[1:depth] as path, depth
      from (select label, parts, unnest(range(1, len(parts) + 1)) as depth from parts))"""


@query(
    f"""with {_NODES} select label, array_to_string(path, ' > ') as path, cast(depth as bigint) as depth,
      path[-1] as name, array_to_string(path[1:depth - 1], ' > ') as parent from nodes"""
)
def path_tree(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return nodes.select(
        "label",
        F.array_join("path", " > ").alias("path"),
        "depth",
        "name",
        F.array_join("parent", " > ").alias("parent"),
    )


@query(
    f"""with {_NODES} select label, array_to_string(path, ' > ') as path,
      repeat('---', depth - 1) || path[-1] as line from nodes"""
)
def path_listing(spark, sf_dir):
    listing = categories.tree_listing(_nodes(spark, sf_dir), "label")
    return listing.select("label", F.array_join("path", " > ").alias("path"), "line")


@query(
    f"""with {_NODES} select label, array_to_string(path, ' > ') as path from nodes n
    where not exists (select 1 from nodes c where c.label = n.label and c.depth = n.depth + 1
      and c.path[1:n.depth] = n.path)"""
)
def leaf_paths(spark, sf_dir):
    return categories.leaf_paths(_nodes(spark, sf_dir), "label")


@query(
    f"""with {_NODES},
    third as (select label, path[1:2] as path, '{{' || string_agg('"' || path[3] || '":{{}}', ','
      order by path[3]) || '}}' as json from nodes where depth = 3 group by 1, 2),
    second as (select n.label, n.path[1:1] as path, '{{' || string_agg('"' || n.path[2] || '":'
      || coalesce(json, '{{}}'), ',' order by n.path[2]) || '}}' as json
      from nodes n left join third t on n.label = t.label and n.path = t.path where depth = 2 group by 1, 2)
    select n.label, '{{' || string_agg('"' || n.path[1] || '":' || coalesce(json, '{{}}'), ','
      order by n.path[1]) || '}}' as tree
    from nodes n left join second s on n.label = s.label and n.path = s.path where depth = 1 group by 1"""
)
def tree_documents(spark, sf_dir):
    return papers.tree_documents(_nodes(spark, sf_dir), "label")


@query(
    f"""with {_PATHS} select label, split_part(path, ' > ', 1) as parent, count(distinct id) as papers
    from lines group by 1, 2"""
)
def papers_per_category(spark, sf_dir):
    return categories.papers_per_category(_papers(spark, sf_dir), "label", "categories")


@query(
    f"""with {_PATHS} select label, split_part(categories, ' > ', 1) as parent, count(*) as papers
    from paths where categories <> '' group by 1, 2"""
)
def papers_per_category_first(spark, sf_dir):
    return categories.papers_per_category(_papers(spark, sf_dir), "label", "categories", "first")


_PAPERS = """listed as (select cast(c_custkey as varchar) as id, r_name || ' > ' || n_name as first,
      c_mktsegment || ' > ' || n_name as second
      from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
    labelled as (select cast(o_custkey as varchar) as id, arg_min(o_orderkey % 5, o_orderkey) as SDG from orders
      where o_custkey % 5 <> 0 group by 1),
    found as (select * from listed join labelled using (id))"""


def _labelled_papers(spark, sf_dir):
    """Customers with both category keys and another one; their first order gives the class.

    The label rows of every fifth customer have lost their id.
    """
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_name")
    placed = customers.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    first, second = (F.lit(key) for key in fixed.CATEGORY_KEYS)
    meta = F.create_map(
        first, F.concat_ws(" > ", "r_name", "n_name"), second, F.concat_ws(" > ", "c_mktsegment", "n_name"),
        F.lit("Other"), F.col("c_name"),
    )
    listed = placed.select(F.col("c_custkey").cast("string").alias("id"), meta.alias("meta"))
    labels = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey").cast("string")).alias("ID"), (F.col("o_orderkey") % 5).alias("SDG"), F.col("o_orderkey").alias("row_no")
    )
    return papers.label_papers(listed, labels)


@query(
    f"""with {_PAPERS}, lines as (select SDG, first as path from found union select SDG, second from found),
    parts as (select SDG, string_split(path, ' > ') as parts from lines)
    select SDG, parts[1] as path from parts union select SDG, parts[1] || ' > ' || parts[2] from parts"""
)
def category_job(spark, sf_dir):
    """Papers with their first class, and the tree of both category keys of each class."""
    found, _ = _labelled_papers(spark, sf_dir)
    return papers.category_tree(found).select("SDG", F.array_join("path", " > ").alias("path"))


@query(f"with {_PAPERS} select SDG, split_part(first, ' > ', 1) as parent, count(*) as papers from found group by 1, 2")
def faculty_job(spark, sf_dir):
    found, _ = _labelled_papers(spark, sf_dir)
    return papers.faculty_counts(found)


@query(f"with {_PAPERS} select id from listed where id not in (select id from labelled)")
def unlabelled_papers(spark, sf_dir):
    _, missing = _labelled_papers(spark, sf_dir)
    return missing.select("id")


# --- spanned tables: events in order, some of which start a target -----------------

_FILLED = """shaped as (select event_type as goal, event_id as row_no,
      case when value > 30 then cast(user_id as varchar) end as own_target,
      case when value > 30 then event_id end as own_run, props as indicator
      from events where value > 5),
    filled as (select goal, row_no,
      last_value(own_target ignore nulls) over w as target, last_value(own_run ignore nulls) over w as run,
      indicator from shaped window w as (partition by goal order by row_no
        rows between unbounded preceding and current row))"""


def _filled(spark, sf_dir):
    """Three cells start a target, two continue it, one cell is ignored."""
    value = F.col("value")
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("goal"),
        F.col("event_id").alias("row_no"),
        F.when(value > 30, F.array(F.col("user_id").cast("string"), F.col("props"), F.lit("code")))
        .when(value > 5, F.array(F.col("props"), F.lit("code")))
        .otherwise(F.array("props"))
        .alias("cells"),
    )
    return targets.fill_targets(events, chunk=1_000)


@query(f"with {_FILLED} select * from filled")
def forward_fill(spark, sf_dir):
    return _filled(spark, sf_dir)


@query(f"with {_FILLED} select * from filled where run is null")
def rejected_rows(spark, sf_dir):
    return targets.rejected_rows(_filled(spark, sf_dir))


_INDICATORS = f"""{_FILLED},
    lasts as (select goal, target, max(run) as run from filled where run is not null group by 1, 2),
    valid as (select f.* from filled f join lasts using (goal, target, run))"""


@query(f"with {_INDICATORS} select goal, row_no, target, run, indicator from valid")
def target_indicators(spark, sf_dir):
    """Of a repeated target only its last run counts."""
    return targets.indicators(_filled(spark, sf_dir))


@query(
    f"""with {_INDICATORS} select goal, target, cast(0 as bigint) as batch_id,
      array_to_string(list(indicator order by row_no), ';') as indicators from valid group by 1, 2"""
)
def group_indicators(spark, sf_dir):
    lists = target_plans.target_documents(targets.indicators(_filled(spark, sf_dir)))
    return lists.withColumn("indicators", F.array_join("indicators", ";"))


@query(
    """with numbered as (select role, conv_id, turn, cast((row_number() over
      (partition by role order by conv_id, turn) - 1) // 50 as bigint) as batch_id from conversations)
    select role, batch_id, array_to_string(list(conv_id || ':' || turn order by conv_id, turn), ',') as items
    from numbered group by 1, 2"""
)
def nested_lists(spark, sf_dir):
    """Long lists come in parts of bounded length."""
    turns = table(spark, sf_dir, "conversations").select(
        "role", "conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("item")
    )
    lists = batching.nested_lists(turns, ["role"], ["conv_id", "turn"], "item", part_size=50)
    return lists.withColumn("items", F.array_join("items", ","))


# --- landed HTML, built from the rows of a table ---------------------------------------


def _row(*cells):
    return F.concat(F.lit("<tr>"), *cells, F.lit("</tr>\n"))


def _cell(tag, value):
    return F.concat(F.lit(f"<{tag}>"), value, F.lit(f"</{tag}>"))


#: Tables within a cell: so many side by side, and so many within each other.
INNER = 6


def _inner(value, side_by_side=1, levels=1):
    """Tables around a value."""
    nested = F.concat(F.lit("<table><tr><td>" * levels), value, F.lit("</td></tr></table>" * levels))
    return F.concat(*[nested] * side_by_side)


def _metadata_pages(spark, sf_dir):
    c = F.col
    return spread(table(spark, sf_dir, "customer"), "c_custkey").select(
        c("c_custkey").alias("id"),
        F.concat(
            F.lit('<html><div class="x"><table class="a ep_block b"><caption>c</caption>'),
            _row(_cell("th", F.lit("Balance:")), _cell("td", F.lit("old"))),
            _row(_cell("th", F.lit("Name:")), _cell("td", F.concat(F.lit(" <b>"), c("c_name"), F.lit("</b>\n ")))),
            _row(
                _cell("th", F.lit("Segment &amp; Nation:")),
                _cell("td", F.concat(c("c_mktsegment"), F.lit("<br/>"), c("c_nationkey").cast("string"))),
            ),
            _row(_cell("td", F.lit("no header here"))),
            # tables within a cell, side by side and within each other; the row behind is whole
            _row(_cell("th", F.lit("Siblings:")), _cell("td", _inner(c("c_name"), side_by_side=INNER))),
            _row(_cell("th", F.lit("Levels:")), _cell("td", _inner(c("c_name"), levels=INNER))),
            # no closing tags, numeric and named entities, a table within a cell
            F.lit("<tr><th>Caf&eacute; &#233;&#xe9;:<td>"),
            c("c_name"),
            F.lit("<table><tr><td>inner</td></tr></table>"),
            _row(_cell("th", F.lit("Balance:")), _cell("td", (c("c_custkey") % 7).cast("string"))),
            # a table within a cell that never ends
            F.lit("<tr><th>Open:<td>x<table><tr><td>y<table></table></div></html>"),
        ).alias("html"),
    )


@query(
    f"""select c_custkey as id, unnest(['Name:', 'Segment & Nation:', 'Balance:', 'Café éé:', 'Siblings:', 'Levels:']) as key,
      unnest([c_name, c_mktsegment || chr(10) || c_nationkey, cast(c_custkey % 7 as varchar),
        c_name || chr(10) || chr(10) || 'inner', rtrim(repeat(c_name || repeat(chr(10), 4), {INNER}), chr(10)), c_name]) as value
    from customer"""
)
def html_metadata(spark, sf_dir):
    """Key and value rows out of a metadata block; a repeated key keeps its last value."""
    return papers.valid_entries(papers.metadata_entries(_metadata_pages(spark, sf_dir)))


@query(
    """select c_custkey as id, unnest([cast(3 as bigint), 8]) as row_no, unnest([null, 'Open:']) as key,
      unnest([false, true]) as has_value, unnest([true, false]) as closed from customer"""
)
def html_rejects(spark, sf_dir):
    """Rows without a header, and those with a table that never ends."""
    rejected = papers.rejected_entries(papers.metadata_entries(_metadata_pages(spark, sf_dir)))
    value = F.col("value") != "no header here"
    return rejected.select("id", "row_no", "key", value.alias("has_value"), "closed")


def _table_pages(spark, sf_dir):
    c = F.col
    header = _row(_cell("th", F.lit("Target")), _cell("th", F.lit("Indicator")))
    opening = F.lit("<p>text</p><table class='wikitable sortable'>")
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(
        c("p_partkey").alias("page_id"),
        F.concat(
            opening,
            header,
            _row(_cell("td", c("p_name")), _cell("td", c("p_brand")), _cell("td", c("p_type"))),
            _row(_cell("td", c("p_brand")), _cell("td", c("p_size").cast("string"))),
            F.lit("<tr><td>"), c("p_name"), F.lit("<table><tr><td>in</table><td>&eacute;"),
            _row(_cell("td", _inner(c("p_brand"), side_by_side=INNER)), _cell("td", _inner(c("p_type"), levels=INNER))),
            _row(_cell("td", F.lit("whole")), _cell("td", c("p_type"))),
            F.lit("</table>"),
            opening,
            header,
            _row(_cell("td", F.concat(F.lit("<i>"), c("p_type"), F.lit("</i>")))),
            F.lit("</table><table class='other'><tr><td>no</td></tr></table>"),
            opening,
            header,
            _row(_cell("td", F.lit("kept"))),
            F.lit("<tr><td>"), c("p_name"), F.lit("<table><tr><td>never closed</table><table>"),
        ).alias("html"),
    )


_INNER_CELL = f"rtrim(repeat(p_brand || repeat(chr(10), 4), {INNER}), chr(10))"


@query(
    f"""select p_partkey as page_id, goal, row_no, cells from (
      select p_partkey, 1 as goal, 2 as row_no, p_name || '|' || p_brand || '|' || p_type as cells from part
      union all select p_partkey, 1, 3, p_brand || '|' || p_size from part
      union all select p_partkey, 1, 4, p_name || chr(10) || chr(10) || 'in' || '|é' from part
      union all select p_partkey, 1, 5, {_INNER_CELL} || '|' || p_type from part
      union all select p_partkey, 1, 6, 'whole|' || p_type from part
      union all select p_partkey, 2, 2, p_type from part
      union all select p_partkey, 3, 2, 'kept' from part)"""
)
def html_table_rows(spark, sf_dir):
    rows = target_plans.table_rows(_table_pages(spark, sf_dir))
    return rows.withColumn("cells", F.array_join("cells", "|"))


@query("select p_partkey as page_id, 3 as goal, 3 as row_no, p_name || chr(10) || chr(10) || 'never closed' as cells from part")
def html_open_rows(spark, sf_dir):
    """Rows that hold a table without an end."""
    rows = target_plans.open_rows(_table_pages(spark, sf_dir))
    return rows.withColumn("cells", F.array_join("cells", "|"))


@query(
    f"""with rows as (select p_partkey as page_id, 1 as goal, 2 as row_no, p_name as target, p_brand as indicator from part
      union all select p_partkey, 1, 3, p_name, p_type from part
      union all select p_partkey, 1, 4, {_INNER_CELL}, p_type from part
      union all select p_partkey, 1, 5, {_INNER_CELL}, 'last' from part
      union all select p_partkey, 2, 2, p_name, p_type from part)
    select page_id, goal, target, cast(0 as bigint) as batch_id,
      array_to_string(list(indicator order by row_no), ';') as indicators from rows group by 1, 2, 3"""
)
def target_pages(spark, sf_dir):
    """From landed pages to nested lists; every page has its own goals, rows before a target are rejected."""
    c = F.col
    opening = "<table class=wide><tr><td>no</table><table class='wikitable'><tr><th>Target<th>Indicator"
    pages = spread(table(spark, sf_dir, "part"), "p_partkey").select(
        c("p_partkey").alias("page_id"),
        F.concat(
            F.lit(opening + "<tr><td>"), c("p_name"), F.lit("<td>"), c("p_brand"), F.lit("<td>c<tr><td>"), c("p_type"),
            F.lit("<td>c<tr><td>"), _inner(c("p_brand"), side_by_side=INNER), F.lit("<td>"), _inner(c("p_type"), levels=INNER),
            F.lit("<td>c<tr><td>last<td>c"),
            F.lit("</table>" + opening + "<tr><td>"), c("p_name"), F.lit("<td>"), c("p_type"), F.lit("<td>c</table>"),
            F.lit(opening + "<tr><td>lost<td>c</table>"),
        ).alias("html"),
    )
    valid, _ = target_plans.goal_targets(target_plans.table_rows(pages))
    lists = target_plans.target_documents(valid)
    return lists.withColumn("indicators", F.array_join("indicators", ";"))


# --- model: trained on one part, evaluated on the other --------------------------------------

_PARTS = f"""prepared as (select doc_id as row_id, {sql_process_text('text')} as text_clean, quality as label, 1 as is_abstract
      from documents left join labels using (doc_id)),
    usable as (select * from prepared where label is not null),
    firsts as (select row_id as first_id from (select *, row_number() over
      (partition by label order by {sql_key(42, 'row_id')}, row_id) as rn from usable) where rn <= 1),
    rest as (select * from usable where row_id not in (select first_id from firsts)),
    {sql_stratified('rest', 'label', 'row_id')},
    held as (select tested_id as row_id from tested union select first_id from firsts),
    train as (select * from usable where row_id not in (select row_id from held)),
    counts as (select label, token, count(*) as n from (select label, unnest(string_split(text_clean, ' ')) as token
      from train) where token <> '' group by 1, 2),
    classes as (select label, count(*) as rows, (select count(*) from train) as every,
      coalesce((select sum(n) from counts c where c.label = t.label), 0) + (select count(distinct token) from counts) as size
      from train t group by label),
    weights as (select label, token, cast(round(ln(n + 1.0::double) * 1000) as bigint) as weight from counts),
    priors as (select label, cast(round(ln(rows::double / every) * 1000) as bigint) as prior,
      cast(round(ln(1.0::double / size) * 1000) as bigint) as unseen from classes),
    asked as (select row_id, label, text_clean from prepared where label is null or row_id in (select row_id from held)),
    words as (select row_id, token from (select row_id, unnest(string_split(text_clean, ' ')) as token
      from asked) where token <> ''),
    lengths as (select u.row_id, u.label as truth, (select count(*) from words w where w.row_id = u.row_id) as size
      from asked u),
    seen as (select row_id, w.label, sum(weight) as seen from words join weights w using (token) group by 1, 2),
    sums as (select s.row_id, truth, p.label, prior + size * unseen + coalesce(seen, 0) as total
      from lengths s cross join priors p left join seen on seen.row_id = s.row_id and seen.label = p.label),
    best as (select row_id, truth, label as prediction from (select *, row_number() over
      (partition by row_id order by total desc, label) as rn from sums) where rn = 1)"""


@query(f"with {_PARTS} select row_id, truth, prediction from best")
def classify(spark, sf_dir):
    """Train on the train part of a rule-based split, predict its test part and the documents without a label."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("row_id"), process_text(F.col("text")).alias("text_clean"),
        F.col("quality").alias("label"), F.lit(1).alias("is_abstract"),
    )
    rows = stage(rows, "prepared")
    split = stage(sampling.rule_based_split(rows.filter(F.col("label").isNotNull())), "split")
    model = classifier.train_counts(split.filter("split = 'train'"))
    asked = rows.filter(F.col("label").isNull()).unionByName(split.filter("split = 'test'").drop("split"))
    found = classifier.score_counts(model, asked, "row_id")
    return asked.select("row_id", F.col("label").alias("truth")).join(found, "row_id")


@query()
def training_epochs(spark, sf_dir):
    """Trained on one part, scored on the development part after every epoch; floating-point sums have no SQL."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = stage(
        documents.join(labels, "doc_id").select(
            F.col("doc_id").alias("row_id"), process_text(F.col("text")).alias("text_clean"),
            F.col("quality").alias("label"), F.lit(1).alias("is_abstract"),
        ),
        "labelled",
    )
    split = stage(splits.three_way_split(rows), "split")
    model = classifier.train_epochs(split.filter("split = 'train'"), split.filter("split = 'validation'"))
    return classifier.epoch_table(model, split)


@query(
    f"""select doc_id, array_to_string(string_split({sql_process_text('text')}, ' ')[1:256], ' ') as tokens from documents"""
)
def truncate_tokens(spark, sf_dir):
    """The first tokens of each text: the cut-off as an operator of its own."""
    documents = table(spark, sf_dir, "documents")
    tokens = F.split(process_text(F.col("text")), " ")
    return documents.select("doc_id", F.array_join(cut_tokens(tokens), " ").alias("tokens"))
