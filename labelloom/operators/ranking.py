"""Ranks, positions and exact k-smallest cuts that survive a hot group.

A plain ``row_number`` over a group sorts the whole group in one task. These
operators give the same numbers with work spread over many tasks even if one
group holds most of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.sources.staging import stage

# Leading hexadecimal digits of a random key: 16^4 = 65,536 even buckets.
BUCKET_DIGITS = 4
# Bounds drawn per group and round of a selection, and the rows that one task may rank.
PIVOTS, RANKED = 64, 100_000


def _bucket(key: str) -> Column:
    return F.substring(F.col(key), 1, BUCKET_DIGITS)


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Null-safe equality of the named columns."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def _parsed(order: Sequence[str]) -> list[tuple[str, bool]]:
    """Column names and whether they fall: ``-name`` is in falling order."""
    return [(name.removeprefix("-"), name.startswith("-")) for name in order]


def _before(left: Callable[[str], Column], right: Callable[[str], Column], order: Sequence[str]) -> Column:
    """Whether one row comes strictly before another; nulls are least, as in a sort."""
    found, equal = F.lit(False), F.lit(True)
    for name, falls in _parsed(order):
        a, b = (right(name), left(name)) if falls else (left(name), right(name))
        less = F.coalesce(a < b, a.isNull() & b.isNotNull())
        found, equal = found | (equal & less), equal & a.eqNullSafe(b)
    return found


def kth_per_group(keys: DataFrame, group: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """(group, cut): the k-th row's order columns for every group that has more than k rows.

    Distributed selection over a staged frame of group and order columns. Per round every
    open group draws about ``PIVOTS`` bounds from its rows by a hash and counts the rows
    between them; only the bucket with the wanted row goes on. What is left of a group
    is ranked once it is small, and no task ever sees more of a group than that.
    """
    names = [n for n, _ in _parsed(order)]
    sizes = keys.groupBy(*group).agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") > k)
    # No bound below and none above yet.
    none = F.lit(None).cast(T.StructType([keys.schema[n] for n in names]))
    # The columns of a group get names of their own, so that joins are never ambiguous.
    own = [f"_g{i}" for i in range(len(group))]
    state = sizes.select(
        *[F.col(c).alias(o) for c, o in zip(group, own)], "_m", F.lit(k).cast("bigint").alias("_take"), none.alias("_low"), none.alias("_high")
    )
    state, cuts, number = stage(state, "selection"), [], 0
    key = F.struct(*names)

    def inside(part: DataFrame) -> DataFrame:
        """The rows of the open groups that lie between their bounds."""
        matched = keys.join(part, _matches(keys, part, group, own))
        above = F.col("_low").isNull() | _before(lambda n: F.col("_low")[n], lambda n: F.col(n), order)
        below = F.col("_high").isNull() | ~_before(lambda n: F.col("_high")[n], lambda n: F.col(n), order)
        return matched.filter(above & below).select(*own, "_m", "_take", key.alias("_key"), *names)

    while True:
        small, large = state.filter(F.col("_m") <= RANKED), state.filter(F.col("_m") > RANKED)
        sort = [F.col(n).desc() if falls else F.col(n) for n, falls in _parsed(order)]
        ranked = inside(small).withColumn("_rank", F.row_number().over(Window.partitionBy(*own).orderBy(*sort)))
        cuts.append(stage(ranked.filter(F.col("_rank") == F.col("_take")).select(*own, F.col("_key").alias("_cut")), "cut"))
        if not large.take(1):
            break
        number += 1
        # A row is drawn by its hash: the same ones in every run.
        drawn = F.pmod(F.xxhash64(*names, F.lit(number)), F.col("_m")) < PIVOTS
        chosen = inside(large).filter(drawn).groupBy(*own).agg(F.collect_set("_key").alias("_drawn"))
        at = lambda row: lambda n: row[n]
        pivots = F.array_sort(
            "_drawn", lambda x, y: F.when(_before(at(x), at(y), order), -1).when(_before(at(y), at(x), order), 1).otherwise(0)
        )
        bounds = stage(chosen.select(*own, pivots.alias("_pivots")), "bounds")
        bounds = bounds.select(*[F.col(o).alias(f"{o}_") for o in own], "_pivots")
        rows = inside(large)
        # Rows up to the first bound are bucket 0, rows behind the last one the last bucket.
        bucketed = rows.join(bounds, _matches(rows, bounds, own, [f"{o}_" for o in own]), "left")
        passed = F.filter(F.coalesce("_pivots", F.array()), lambda p: _before(at(p), lambda n: F.col(n), order))
        counts = bucketed.groupBy(*own, "_m", "_take", "_pivots", F.size(passed).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*own).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
        hit = counts.withColumn("_upto", upto).filter(
            (F.col("_upto") >= F.col("_take")) & (F.col("_upto") - F.col("_n") < F.col("_take"))
        )
        old = large.select(*[F.col(o).alias(f"{o}_") for o in own], "_low", "_high")
        narrowed = hit.join(old, _matches(hit, old, own, [f"{o}_" for o in own])).select(
            *own,
            F.col("_n").alias("_m"),
            (F.col("_take") - F.col("_upto") + F.col("_n")).alias("_take"),
            F.coalesce(F.get("_pivots", F.col("_bucket") - 1), F.col("_low")).alias("_low"),
            F.coalesce(F.get("_pivots", F.col("_bucket")), F.col("_high")).alias("_high"),
            (F.col("_n") == F.col("_m")).alias("_stuck"),
        )
        narrowed = stage(narrowed, "selection")
        # Only rows that are equal in all order columns cannot be told apart.
        stuck = narrowed.filter("_stuck")
        if stuck.take(1):
            ends = inside(stuck).groupBy(*own).agg(F.min("_key").alias("_cut"), F.max("_key").alias("_last"))
            cuts.append(stage(ends.filter(F.col("_cut").eqNullSafe(F.col("_last"))).drop("_last"), "cut"))
            done = cuts[-1].select(*[F.col(o).alias(f"{o}_") for o in own])
            narrowed = narrowed.join(done, _matches(narrowed, done, own, [f"{o}_" for o in own]), "left_anti")
        state = stage(narrowed.drop("_stuck"), "selection")
    result = cuts[0]
    for cut in cuts[1:]:
        result = result.unionByName(cut)
    return result.withColumnsRenamed(dict(zip(own, group)))


def _matches(left: DataFrame, right: DataFrame, names: Sequence[str], others: Sequence[str]) -> Column:
    condition = F.lit(True)
    for a, b in zip(names, others):
        condition = condition & left[a].eqNullSafe(right[b])
    return condition


def first_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[str], k: int = 1
) -> DataFrame:
    """The k first rows of every group; ``-name`` in ``order`` means falling.

    Rows that equal the k-th one in all order columns are all kept, so give an order
    without ties. The frame is read twice: once for its group and order columns, which are
    staged, and once to compare every row with its group's cut. Rows are neither
    sorted nor shuffled as long as the cuts, one row per group, can be broadcast.
    """
    names = [n for n, _ in _parsed(order)]
    keys = stage(df.select(*dict.fromkeys([*group, *names])), "order-keys")
    cuts = kth_per_group(keys, group, order, k)
    named = cuts.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], "_cut")
    named = stage(named, "cuts")
    marked = df.join(named, _matches(df, named, group, [f"_g{i}" for i in range(len(group))]), "left")
    behind = _before(lambda n: F.col("_cut")[n], lambda n: df[n], order)
    return marked.filter(F.col("_cut").isNull() | ~behind).select(*[df[c] for c in df.columns])


def random_position(
    df: DataFrame, group: Sequence[str], key: str, row_id: str, name: str = "position"
) -> DataFrame:
    """Number the rows of each group from 1 in the order of a random key.

    ``key`` holds random hexadecimal digits. Rows are ranked inside buckets of
    the key; bucket counts give each bucket its offset.
    """
    # A struct of the group's columns is never null, so plain equality serves
    # null groups too, and window and join share one shuffle.
    place = ["_group", "_bucket"]
    bucketed = df.withColumn("_group", F.struct(*group)).withColumn("_bucket", _bucket(key))
    counts = bucketed.groupBy(*place).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        *place, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*place).orderBy(key, row_id)
    ranked = bucketed.withColumn("_rank", F.row_number().over(inside))
    return ranked.join(offsets, place).select(
        *df.columns, (F.col("_offset") + F.col("_rank")).cast("bigint").alias(name)
    )


def smallest_k_cut(
    rows: DataFrame,
    label: str,
    key: str,
    row_id: str,
    quotas: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Per label the (key, row id) of its quota-th smallest row, as a staged table.

    ``quotas`` maps the label sizes (label, n) to (label, quota); a label with
    quota 0 has no cut. Two passes read only label, key and row id: one counts
    the buckets, one ranks the single bucket per label that holds the cut.
    ``rows`` never need a shuffle of their own: whoever compares them with the
    cut joins one row per label.
    """
    bucketed = rows.select(label, key, row_id).withColumn("_bucket", _bucket(key))
    counts = stage(bucketed.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_n")), "counts")
    wanted = quotas(counts.groupBy(label).agg(F.sum("_n").alias("n")))
    upto = Window.partitionBy(label).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, 0
    )
    running = counts.withColumn("_upto", F.sum("_n").over(upto))
    boundary = running.join(wanted, _same(running, wanted, [label])).filter(
        (F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("_n") < F.col("quota"))
    )
    boundary = stage(
        boundary.select(
            running[label],
            "_bucket",
            (F.col("quota") - F.col("_upto") + F.col("_n")).alias("_take"),
        ),
        "boundary",
    )
    candidates = bucketed.join(boundary, _same(bucketed, boundary, [label, "_bucket"]))
    inside = Window.partitionBy(bucketed[label]).orderBy(key, row_id)
    cut = (
        candidates.withColumn("_rank", F.row_number().over(inside))
        .filter(F.col("_rank") == F.col("_take"))
        .select(bucketed[label], F.struct(key, row_id).alias("cut"))
    )
    return stage(cut, "cut")


def ordered_position(
    df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "position"
) -> DataFrame:
    """Number the rows of each group from 1 in the given order.

    Only the distinct group and order columns are range-sorted and staged, so a hot
    group spreads over many ranges; per-range counts then give each range its
    offset. The rows themselves move once, to meet the position of their key. Rows with
    equal keys get neighbouring numbers.
    """
    keys = [*group, *order]
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).orderBy(*keys)
    # Staged, because range bounds are sampled anew in every run.
    staged = stage(
        counted.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_place")), "sorted"
    )
    repeated = (staged.agg(F.max("_n")).first()[0] or 0) > 1
    ranges = staged.groupBy(*group, "_range").agg(F.sum("_n").alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = ranges.select(
        *group, "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    offsets = stage(offsets, "ranges")
    inside = F.col("_place") - F.col("_first")
    if repeated:
        within = Window.partitionBy(*[staged[c] for c in (*group, "_range")]).orderBy("_place")
        inside = F.coalesce(F.sum(staged["_n"]).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = [f"_k{i}" for i in range(len(keys))]
    starts = staged.join(offsets, _same(staged, offsets, [*group, "_range"])).select(
        *[staged[c].alias(o) for c, o in zip(keys, own)], (F.col("_offset") + inside + 1).alias("_start")
    )
    placed = df.join(starts, _matches(df, starts, keys, own))
    position = F.col("_start")
    if repeated:
        position = position + F.row_number().over(Window.partitionBy(*own).orderBy("_start")) - 1
    return placed.select(*[df[c] for c in df.columns], position.cast("bigint").alias(name))
