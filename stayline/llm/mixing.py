"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed place in [0, 16^DIGITS): leading digits of a hash of its id. A source takes
each document as often as its target covers the whole source, and once more documents in the order of their places, as far
as they fit into what is left. The place where that ends is found from histograms: sum sizes by source and hash bucket, find the
bucket in which the running sum crosses the budget, and cut only that bucket finer, until single places are
left. If what does not fit there leaves the source short by more than one in ``NEAR`` of its target, the search goes on
behind it, among documents that fit into what is still open. A source's turns are few: each ends at a place that is larger than the room
and leaves less than that place's size. Documents are then filtered by their place; nothing is sorted.

All documents of one id share a place and are taken or left together. The sum taken stays at or below the target. It is short of
it by one in ``NEAR`` at most, or by less than the smallest place left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.session import durable

SHARE = (3, 2)  # the mix has 3/2 of all words
MOST = 2  # times its size that a source gives at most
WEIGHTS = (5, 2, 1)  # by code point order of the sources, repeating
DIGITS = 12
STEP = 4  # hex digits per refinement: 65,536 buckets a source
NEAR = 1000  # a source is near enough if it is short of its target by one in so many
WIDE = "decimal(38,0)"


def place(key: Column) -> Column:
    """Hex digits of a hash of the id; a null id has a place of its own."""
    return F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, DIGITS)


def word_count(text: Column) -> Column:
    """Runs of characters that are not blanks (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_weights(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds ``weight``: the given ones in turn, sources by code point, null last. One row per source."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    given = F.array(*[F.lit(w) for w in weights])
    return totals.withColumn("weight", F.element_at(given, (turn + 1).cast("int")).cast("bigint"))


def with_targets(
    weighted: DataFrame, share: tuple[int, int] = SHARE, most: int = MOST
) -> DataFrame:
    """Adds ``target`` (double) to (source, source_size, weight), one row per source.

    The share of all words goes to the sources by weight. What exceeds ``most`` times a source's size is shared
    among the others by weight, until none exceeds. That ends where the sources with the smallest size per
    weight are full: in that order a source is full if its share of what the ones before leave is no less than
    its limit. Whole numbers decide; only the last division is of doubles.
    """
    up, down = share
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    size = F.col("source_size").cast(WIDE)
    # Everything times `down`, so that shares stay whole.
    full = size * (most * down)
    left = F.sum(size).over(Window.partitionBy()) * up - F.coalesce(F.sum(full).over(before), F.lit(0))
    sums = weighted.select(
        "*", full.alias("_full"), left.cast(WIDE).alias("_left"), F.sum("weight").over(after).alias("_rest")
    ).withColumn(
        "_is_full", F.col("_full") * F.col("_rest") < F.col("_left") * F.col("weight")
    )
    # What is left, and among which weights, once all full sources are served: the first source not full says it.
    everything = Window.partitionBy()
    open_left = F.max(F.when(~F.col("_is_full"), F.struct(F.col("_rest"), F.col("_left")))).over(everything)
    target = F.when(F.col("_is_full"), F.col("source_size") * F.lit(float(most))).otherwise(
        F.col("weight").cast("double") * open_left["_left"].cast("double")
        / (open_left["_rest"].cast("double") * F.lit(float(down)))
    )
    return sums.withColumn("target", target).select("source", "source_size", "weight", "target")


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, below, room): documents whose place is less than ``below`` fit the source's ``budget`` and leave ``room``.

    ``sized`` has (source, place, size), ``budgets`` (source, whole budget), one row per source. Sources without a row are those
    all of whose documents fit.
    """
    edge = durable(budgets.select("source", F.lit("").alias("prefix"), F.col("budget").cast(WIDE).alias("_room")))
    for digits in range(STEP, DIGITS + 1, STEP):
        bucket = F.substring("place", 1, digits)
        # Only documents of the boundary bucket that the last round left open.
        inside = sized.join(edge, sized["source"].eqNullSafe(edge["source"]), "inner").where(
            F.substring("place", 1, digits - STEP) == F.col("prefix")
        )
        sums = inside.groupBy(edge["source"], bucket.alias("bucket")).agg(
            F.sum(F.col("size").cast(WIDE)).alias("_sum"), F.first("_room").alias("_room")
        )
        run = Window.partitionBy("source").orderBy("bucket")
        crossing = (
            sums.withColumn("_upto", F.sum("_sum").over(run))
            .where(F.col("_upto") > F.col("_room"))
            .groupBy("source")
            .agg(
                F.min(F.struct("bucket", (F.col("_room") - (F.col("_upto") - F.col("_sum"))).alias("_room")))
                .alias("_c")
            )
        )
        edge = durable(
            crossing.select("source", F.col("_c.bucket").alias("prefix"), F.col("_c._room").cast(WIDE).alias("_room"))
        )
    return edge.select("source", F.col("prefix").alias("below"), F.col("_room").alias("room"))


def fitting(units: DataFrame, budgets: DataFrame, near: int = NEAR) -> DataFrame:
    """(source, turns): a source takes a place once more if any turn (after, below, most) has it between ``after`` and ``below``
    (null: no end), and its size is ``most`` at most.

    ``units`` has (source, place, size), one row per place, stored; ``budgets`` (source, budget, target).
    """
    open_ = durable(budgets.select("source", F.lit("").alias("after"), F.col("budget").cast(WIDE).alias("budget"), "target"))
    turns = None
    while True:
        left = open_.withColumnRenamed("source", "_of")
        fits = units.join(left, units["source"].eqNullSafe(left["_of"])).where(
            (F.col("place") > F.col("after")) & (F.col("size") <= F.col("budget")) & (F.col("size") > 0)
        )
        cut = thresholds(fits.select("source", "place", "size"), open_).withColumnRenamed("source", "_of")
        done = durable(
            open_.join(cut, open_["source"].eqNullSafe(cut["_of"]), "left").select(
                "source", "after", "below", F.col("budget").alias("most"), "room", "target"
            )
        )
        own = done.select("source", "after", "below", "most")
        turns = own if turns is None else turns.unionByName(own)
        open_ = durable(
            done.where(F.col("room") * near > F.col("target").cast(WIDE)).select(
                "source", F.col("below").alias("after"), F.col("room").alias("budget"), "target"
            )
        )
        if open_.isEmpty():
            return durable(turns.groupBy("source").agg(F.collect_list(F.struct("after", "below", "most")).alias("turns")))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, place, size) of ``docs``, stored."""
    return durable(
        docs.select(
            F.col("doc_id"), "source", place(F.col("doc_id")).alias("place"), word_count(F.col("text")).alias("size")
        )
    )


def mix_plan(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, source_size, weight, target, copies, turns), one row per source, and (source, place, unit) of the places that several
    rows share with their size in sum. ``sized`` as ``sizes`` makes it."""
    units = durable(sized.groupBy("source", "place").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    totals = units.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = durable(with_targets(source_weights(totals)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("copies", whole.cast("bigint"))
    rest = plan.select(
        "source", F.floor(F.col("target") - F.col("copies") * F.col("source_size")).alias("budget"), "target"
    )
    turns = fitting(units.select("source", "place", "size"), rest).withColumnRenamed("source", "_of")
    shared = durable(units.where("n > 1").select("source", "place", F.col("size").alias("unit")))
    return durable(plan.join(turns, plan["source"].eqNullSafe(turns["_of"]), "left").drop("_of")), shared


def taken(rows: DataFrame, plan: DataFrame, shared: DataFrame) -> DataFrame:
    """``rows`` (with of, place and size) with source_size, target and repeats. Of the plan, rows get what is between their
    columns and the source's; both tables are small unless very many sources or repeated ids make them large."""
    named = shared.select(F.col("source").alias("_of"), F.col("place").alias("_at"), "unit")
    full = rows.join(named, rows["of"].eqNullSafe(named["_of"]) & (rows["place"] == named["_at"]), "left").drop("_of", "_at")
    both = full.join(plan, full["of"].eqNullSafe(plan["source"]))
    unit = F.coalesce("unit", "size")
    extra = F.exists(
        "turns",
        lambda t: (F.col("place") > t["after"]) & (t["below"].isNull() | (F.col("place") < t["below"])) & (unit <= t["most"]),
    )
    more = (F.col("size") > 0) & F.coalesce(extra, F.lit(False))
    return both.withColumn("repeats", F.col("copies") + more.cast("int"))


def mixed(docs: DataFrame) -> DataFrame:
    """Documents with ``size``, their source's ``source_size`` and ``target``, and how often the mix takes them
    (``repeats``).

    Needs doc_id, text and source; any other column is kept. Null and empty texts have size 0 and are never
    taken more often than their source as a whole. Null is a source like any other. Repeated rows of an id are
    taken alike. An empty table gives no rows. Columns that clash with the added ones are replaced.
    """
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "repeats")]
    plan, shared = mix_plan(sizes(docs))
    rows = docs.select(
        F.struct(*own).alias("row"), F.col("source").alias("of"), word_count(F.col("text")).alias("size"),
        place(F.col("doc_id")).alias("place"),
    )
    return taken(rows, plan, shared).select("row.*", "size", "source_size", "target", "repeats")


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, repeats) as ``mixed`` gives them; the texts are read once."""
    sized = sizes(docs)
    plan, shared = mix_plan(sized)
    rows = sized.select("doc_id", F.col("source").alias("of"), "place", "size")
    return taken(rows, plan, shared).select("doc_id", "size", "source_size", "target", "repeats")
