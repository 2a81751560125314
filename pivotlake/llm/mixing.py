"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Every source gets a share of the total by its weight. A source whose share is more than
``max_epochs`` times what it has is clamped there; the excess goes to the others in
proportion to their weights, until no share is above its cap. A source's target is then
met by whole repetitions of all its documents and one fractional repetition: documents
in a seeded order, as long as that brings their sizes nearer to what is left.

The order is by md5 of seed and id, cut into slices by its first digits. Slices are
summed before anything is ordered, so only the slice in which a source runs out is
sorted; no task sees a whole source, and rows are never shuffled to be taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from pivotlake.llm.tables import stored
from pivotlake.session import materialise

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2
SLICE_DIGITS = 3
FEW = 100_000


def _same(left: str, right: str):
    return F.col(left).eqNullSafe(F.col(right))


def _few(per_source: DataFrame) -> DataFrame:
    """Computed once, and sent to all tasks if it has at most ``FEW`` rows."""
    per_source = materialise(per_source)
    return F.broadcast(per_source) if per_source.count() <= FEW else per_source


def _placed(documents: DataFrame, seed: int) -> DataFrame:
    """With place, the seeded order of an id, and the slice of the order it lies in."""
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return documents.withColumns({"place": place, "slice": F.substring(place, 1, SLICE_DIGITS)})


def sizes(documents: DataFrame) -> DataFrame:
    """``documents`` with size: the number of runs free of ASCII white space; null has 0."""
    spaced = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    words = F.when(F.length(spaced) > 0, F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1)
    return documents.withColumn("size", F.coalesce(words, F.lit(0)).cast("bigint"))


def targets(sized: DataFrame, weights=WEIGHTS, total_share=TOTAL_SHARE, max_epochs=MAX_EPOCHS) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources take ``weights`` in turn by code point, null last. Rounds of clamping are
    aggregates over one row per source; a round is repeated while it clamps another one.
    Only three numbers a round come to the driver.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source, so that numbering them in one task is small.
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn % len(weights) + 1).cast("int"))
    per_source = materialise(by_source.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(max_epochs)).alias("cap")))
    goal = per_source.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * float(total_share)
    level = 0.0
    clamped = F.lit(False)
    while True:
        free = per_source.agg(
            F.sum(F.when(clamped, F.col("cap")).otherwise(0.0)), F.sum(F.when(~clamped, F.col("weight")).otherwise(0.0)), F.sum(F.when(clamped, 1).otherwise(0))
        ).first()
        if not free[1]:
            break
        level = (goal - free[0]) / free[1]
        over = F.col("weight") * F.lit(level) > F.col("cap")
        clamped = clamped | over
        if per_source.where(clamped).count() == free[2]:
            break
    return per_source.select("source", "source_size", F.when(clamped, F.col("cap")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def cutoffs(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with cutoff: up to which place of its order a source is taken once more.

    ``rows`` has source, size, slice and at, the place in the order. The slice in which a
    source runs out is found from slice sums; only rows of that slice are ordered. The rows
    at which it runs out are taken too if that comes nearer to the target.
    """
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    # At most 16^SLICE_DIGITS rows a source.
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slices = slices.withColumn("upto", F.sum("slice_size").over(upto)).join(wanted, _same("source", "of_source"))
    last = slices.where("upto > rest AND upto - slice_size <= rest").groupBy("of_source").agg(
        F.min(F.struct("slice", (F.col("rest") - F.col("upto") + F.col("slice_size")).alias("left"))).alias("cut")
    )
    last = _few(last.select(F.col("of_source").alias("cut_source"), "cut.slice", "cut.left"))
    inside = rows.withColumnRenamed("slice", "of_slice").join(last, _same("source", "cut_source") & (F.col("of_slice") == F.col("slice")))
    # Equal rows share their fate, so they are one step of the order.
    inside = inside.groupBy("cut_source", "slice", "left", "at").agg(F.sum("size").alias("step"))
    along = Window.partitionBy("cut_source").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("upto", F.sum("step").over(along))
    nearer = (F.col("upto") - F.col("step") < F.col("left")) & (2 * F.col("upto") - F.col("step") < 2 * F.col("left"))
    reached = inside.groupBy("cut_source", "slice").agg(F.max(F.when((F.col("upto") <= F.col("left")) | nearer, F.col("at"))).alias("at"))
    # Where the whole source fits there is no last slice; where none of the last slice fits, "at" is null.
    return (
        wanted.join(reached.withColumnRenamed("at", "last_at"), _same("of_source", "cut_source"), "left")
        .withColumn("all", F.col("slice").isNull() & (F.col("rest") >= F.col("source_size")))
        .drop("cut_source")
    )


def mixed(documents: DataFrame, seed: int = 7, weights=WEIGHTS, total_share=TOTAL_SHARE, max_epochs=MAX_EPOCHS, keep: Sequence[str] | None = None) -> DataFrame:
    """Per row of ``documents``: row, size, source_size, target and times.

    ``row`` is the row itself, or its columns ``keep``. ``times`` is how often the mix takes
    the row, ``size * times`` how many words. A source without words is not taken. A
    document without words costs nothing and is taken with its neighbours in the order; a
    null source is a source. Rows of equal id, size and text share their place and fate.

    Texts are read once to count their words, which is written; whole rows are read once
    more to be taken, kept columns are written along.
    """
    kept = F.struct("*" if keep is None else F.col(keep[0]), *(keep[1:] if keep else ()))
    given = documents.select("doc_id", "source", "text", kept.alias("row"))
    at = F.struct("place", "size", F.xxhash64("text").alias("code")).alias("at")
    placed = sizes(_placed(given, seed)).select("source", "size", "slice", at, "row")
    narrow = stored(placed if keep is not None else placed.drop("row"), "sizes")
    wanted = targets(narrow, weights, total_share, max_epochs)
    wanted = wanted.select(
        F.col("source").alias("of_source"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint").alias("whole"),
    )
    wanted = materialise(wanted.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    plan = _few(cutoffs(narrow, wanted))
    once_more = (
        F.when((F.col("source_size") == 0) | (F.col("rest") <= 0), False)
        .when(F.col("slice").isNull(), F.col("all"))
        .when(F.col("own_slice") != F.col("slice"), F.col("own_slice") < F.col("slice"))
        .otherwise(F.coalesce(F.col("at") <= F.col("last_at"), F.lit(False)))
    )
    rows = (placed if keep is None else narrow).withColumnRenamed("slice", "own_slice").join(plan, _same("source", "of_source"))
    return rows.select("row", "size", "source_size", "target", (F.col("whole") + once_more.cast("bigint")).alias("times"))


def repeated(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns of ``documents``."""
    rows = mixed(documents, **options).where("times > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
