"""Mixing sources to target weights by entropy balancing.

Each source shall give a number of words (its target).  Of all document rates
``r_d`` in [0, cap] that meet the targets, entropy balancing takes those nearest to
the even rate in relative entropy (of ``r_d / cap`` and of its complement, so the cap
holds).  The solution tilts the odds of a document exponentially with its size,

    r_d = cap / (1 + exp(-lambda_source * size_d / mean_source)),

and ``lambda`` maximises a concave dual whose gradient is ``target - sum r_d size_d``.
Newton's method solves it: each iteration is one distributed aggregation over the
counts of documents by source and size, and a step that leaves the bracket known
so far is replaced by halving it.

The rates become whole copies by carrying fractions: documents are ordered by source, size
and a hash, their fractional rates add up (in whole units of ``UNITS``, so the sum has no
rounding), and a document gets the extra copy where the running sum passes a
whole number.  Neighbours have nearly the same size, so a source ends within about
one document of its target.  The order is a range partitioning, so a source of any
size is spread over tasks; sums of the partitions before give each task its start.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source of its
own, the last; a source whose documents have no words has target 0; a table
without rows gives none.  A repeated id is a document of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.llm.common import stored, uniform
from foliary.session import cut_lineage

UNITS = 1 << 24
ITERATIONS = 200
TOLERANCE = 1e-10
WORDS = "[^\\x20\\x09-\\x0D]+"


def words(text: Column | str) -> Column:
    """Number of words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(cells: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source, n_docs, source_size, target`` from rows ``source, size, n``.

    Sources in the order of their code points, null last, take the weights in turn.
    They share ``share`` times all words by weight.  A target above ``cap`` times the words
    of its source stops there, and its excess is shared by weight among the others.

    That is ``min(cap * size, level * weight)`` with the one level that uses up
    the share: sources reach their cap in the order of size by weight, so sums along that
    order give the level.  It looks at one row per source.
    """
    by_source = cells.groupBy("source").agg(
        F.sum("n").alias("n_docs"), F.sum(F.col("size") * F.col("n")).alias("source_size")
    )
    # code-point order is the byte order of UTF-8, Spark's order of strings
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.lit([float(w) for w in weights])
    ranked = by_source.withColumn("weight", turn[((F.row_number().over(order) - 1) % len(weights)).cast("int")])
    along = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    after = along.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = (
        ranked.withColumn("full", cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("level", (share * F.sum("source_size").over(everything) - F.col("full")) / F.sum("weight").over(after))
        # the first source that the level does not fill decides it for all after it
        .withColumn("open", F.col("level") * F.col("weight") <= cap * F.col("source_size"))
        .withColumn("level", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    most = cap * F.col("source_size")
    return levels.select(
        "source",
        "n_docs",
        "source_size",
        F.coalesce(F.least(most, F.col("level") * F.col("weight")), most).cast("double").alias("target"),
    )


def rate(tilt: Column, size: Column, mean: Column, cap: float) -> Column:
    return cap / (1 + F.exp(-tilt * size / mean))


def tilts(cells: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """``source, tilt``: the solution of the dual, by Newton iterations.

    ``cells``: ``source, size, n``.  A target at the cap has no finite solution; its
    tilt is null and its rates are the cap.  Likewise a target of 0, with tilt
    null and rate 0, which the caller sees from the target.
    """
    open_ = (F.col("target") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - 1e-12))
    state = targets.where(open_).select(
        "source",
        "target",
        (F.col("source_size") / F.col("n_docs")).alias("mean"),
        F.lit(0.0).alias("tilt"),
        F.lit(float("-inf")).alias("low"),
        F.lit(float("inf")).alias("high"),
        F.lit(False).alias("solved"),
    )
    state = cut_lineage(state)
    for turn in range(ITERATIONS + 1):
        if state.where("not solved").isEmpty():
            break
        if turn == ITERATIONS:
            raise RuntimeError(f"a source is {TOLERANCE} or more from its target after {ITERATIONS} iterations")
        s = state.where("not solved").select(F.col("source").alias("of"), "tilt", "mean")
        part = rate(F.col("tilt"), F.col("size"), F.col("mean"), cap)
        scaled = F.col("size") / F.col("mean")
        sums = (
            cells.join(s, F.col("source").eqNullSafe(F.col("of")))
            .groupBy("of")
            .agg(
                F.sum(F.col("n") * F.col("size") * part).alias("taken"),
                F.sum(F.col("n") * F.col("size") * scaled * part * (1 - part / cap)).alias("slope"),
            )
        )
        taken, target, tilt = F.col("taken"), F.col("target"), F.col("tilt")
        low = F.when(taken < target, tilt).otherwise(F.col("low"))
        high = F.when(taken > target, tilt).otherwise(F.col("high"))
        stepped = state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        stepped = stepped.withColumns({"new_low": low, "new_high": high, "newton": tilt + (target - taken) / F.col("slope")})
        inside = (F.col("newton") > F.col("new_low")) & (F.col("newton") < F.col("new_high")) & ~F.isnan("newton")
        bounded = (F.col("new_low") > float("-inf")) & (F.col("new_high") < float("inf"))
        halved = F.when(bounded, (F.col("new_low") + F.col("new_high")) / 2).when(
            F.col("new_low") > float("-inf"), F.greatest(F.lit(1.0), tilt * 2)
        ).otherwise(F.least(F.lit(-1.0), tilt * 2))
        # Newton's step, kept to a size that cannot overshoot far
        step = F.when(inside & (F.abs(F.col("newton") - tilt) <= 4 * (1 + F.abs(tilt))), F.col("newton")).otherwise(halved)
        done = F.col("solved") | (F.abs(taken - target) <= TOLERANCE * target)
        state = stepped.select(
            "source",
            "target",
            "mean",
            F.when(done, tilt).otherwise(step).alias("tilt"),
            F.when(F.col("solved"), F.col("low")).otherwise(F.col("new_low")).alias("low"),
            F.when(F.col("solved"), F.col("high")).otherwise(F.col("new_high")).alias("high"),
            done.alias("solved"),
        )
        state = cut_lineage(state)
    # sums of doubles may differ in their last digits from run to run; these do not
    return state.select("source", F.round("tilt", 8).alias("tilt"))


def sizes_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        words(F.col(text_col)).alias("size"),
    )


def mixture(
    sizes: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 11
) -> DataFrame:
    """One row per row of ``sizes``: ``doc_id, source, size, source_size, target, rate,
    copies, taken``."""
    sizes = stored(sizes, "mix-sizes")
    cells = cut_lineage(sizes.groupBy("source", "size").agg(F.count("*").alias("n")))
    targets = cut_lineage(source_targets(cells, weights, share, cap))
    tilt = tilts(cells, targets, cap).withColumnRenamed("source", "of")
    known = targets.join(tilt, F.col("source").eqNullSafe(F.col("of")), "left").select(
        F.col("source").alias("of"),
        "source_size",
        "target",
        (F.col("source_size") / F.col("n_docs")).alias("mean"),
        "tilt",
    )
    wanted = (
        F.when((F.col("size") == 0) | (F.col("target") <= 0), F.lit(0.0))
        .when(F.col("tilt").isNull(), F.lit(float(cap)))
        .otherwise(rate(F.col("tilt"), F.col("size"), F.col("mean"), cap))
    )
    rated = (
        sizes.join(known, F.col("source").eqNullSafe(F.col("of")))
        .drop("of")
        .withColumn("rate", wanted)
        .withColumn("units", F.round((F.col("rate") - F.floor("rate")) * UNITS).cast("long"))
        .withColumn("shuffled", uniform("doc_id", seed))
    )
    along = ["size", "shuffled", "doc_id"]
    ranged = stored(
        rated.repartitionByRange("source", *along).withColumn("part", F.spark_partition_id()), "mix-order"
    )
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("part", "source")
        .agg(F.sum("units").alias("sum"))
        .select(
            F.col("part").alias("of_part"),
            F.col("source").alias("of"),
            F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("start"),
        )
    )
    running = Window.partitionBy("part", "source").orderBy(*along)
    upto = F.sum("units").over(running.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    end = F.col("start") + F.col("upto") + UNITS // 2
    extra = F.floor(end / UNITS) - F.floor((end - F.col("units")) / UNITS)
    copies = (F.floor("rate") + extra).cast("long")
    return (
        ranged.withColumn("upto", upto)
        .join(starts, (F.col("part") == F.col("of_part")) & F.col("source").eqNullSafe(F.col("of")))
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            "rate",
            copies.alias("copies"),
            (copies * F.col("size")).alias("taken"),
        )
    )


def mixed(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    **parameters,
) -> DataFrame:
    """``df`` with each row as often as the mix takes it, all columns as they were.

    Decisions and rows meet by id, source and size.  Rows that share all three have the same rate, so their decisions
    differ by one copy at most: two numbers tell them, and the rows are counted off behind the join, where they already
    lie together.  So the texts are shuffled once.
    """
    names = df.columns
    keys = {
        # null is a value of its own; plain columns, so that the join and the window deal rows out alike
        "mix_id": F.coalesce("doc_id", F.lit(0)),
        "mix_no_id": F.col("doc_id").isNull(),
        "mix_source": F.coalesce("source", F.lit("")),
        "mix_no_source": F.col("source").isNull(),
        "mix_size": F.col("size"),
    }
    whole = df.select(
        F.struct(*[df[f"`{n}`"] for n in names]).alias("row"),
        df[f"`{id_col}`"].cast("long").alias("doc_id"),
        df[f"`{source_col}`"].cast("string").alias("source"),
        words(df[f"`{text_col}`"]).alias("size"),
    ).select("row", *[c.alias(n) for n, c in keys.items()])
    decided = (
        mixture(sizes_of(df, id_col, text_col, source_col), **parameters)
        .groupBy(*[c.alias(n) for n, c in keys.items()])
        .agg(F.min("copies").alias("least"), (F.sum("copies") - F.count("*") * F.min("copies")).alias("extra"))
        .where("least + extra > 0")
    )
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("mix_size"))
    return (
        whole.join(decided, list(keys))
        .withColumn("copies", F.col("least") + (nth <= F.col("extra")).cast("long"))
        .where("copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select(*[F.col("row")[n].alias(n) for n in names])
    )
