"""Shards of nearly equal size that keep linked documents together: balanced label propagation.

Documents are linked through hubs: all members of a hub are linked with each other, and no pair of them is ever
written out.  The registered query has one hub for each text that occurs more than once.  A cut link is a pair
of members in different shards.

Linked documents begin in a shard by a hash of their row.  In each round every hub counts its members in each shard, and
every member sums these votes over its hubs and wishes to move to the shard with the most votes
that still has room, if it has more than the member's own shard (which counts the member itself; of
equal shards the one a hash of the smallest hub prefers, so that members of a hub agree).  Room is what
a shard lacks of its quota, an equal share of all bytes; of the wishes for a shard a
share that fits its room is granted, chosen by a hash of row and round.  So a hub moves together until its
shard is full, and a hub larger than a shard fills one after another.  Rounds end when nobody wishes to
move, or after ``rounds``.

Documents without links then fill the shards to equal size: in the order of a hash each takes its
place on the line of what the shards lack.  Repairs follow while a shard is off by more than ``TOLERANCE`` of its share:
documents of over-full shards, unlinked ones first and none larger than twice the excess, move on to shards that lack
bytes; linked ones only for an excess beyond ``LINKED_REPAIR``.

Only votes per hub, and sums per shard (numbers in the driver), are gathered.  Running sums and slots are numbered
in cells of some ten thousand rows, chosen by a hash, with a table of cell totals; no window spans a shard.

Defined cases: a null text has no bytes and is equal to an empty one; rows that repeat an id are rows of their own; an empty table
gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.llm.common import stored, uniform
from foliary.session import cut_lineage

ROUNDS = 12
QUOTA = 0.98  # of an equal share, for linked documents: what chance adds still fits
TOLERANCE = 0.0005
LINKED_REPAIR = 0.002  # excess, as a part of the share, for which linked documents may move
REPAIRS = 6
CELL_ROWS = 20_000


def running(df: DataFrame, groups: list[str], order: str, value: str, cells: int) -> DataFrame:
    """``df`` with ``ahead``: the sum of ``value`` over the rows of the group that come first by ``order`` (in [0, 1)) and ``tag``."""
    celled = df.withColumn("_cell", F.floor(F.col(order) * cells))
    totals = celled.groupBy(*groups, "_cell").agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*groups).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*groups, "_cell", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*groups, "_cell").orderBy(order, "tag").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return celled.join(totals, [*groups, "_cell"]).withColumn("ahead", F.col("_before") + own).drop("_cell", "_before")


def by_shard(df: DataFrame, label: str, shards: int) -> list[int]:
    """The bytes of each shard."""
    out = [0] * shards
    for row in df.groupBy(label).agg(F.sum("size").alias("size")).where(F.col(label).isNotNull()).collect():
        out[row[label]] = row["size"]
    return out


def place_on_line(position: Column, lacks: list[float]) -> Column:
    """The shard whose stretch of the line of lacking bytes holds a position; beyond the line the last that lacks some."""
    at, shard = 0.0, F.lit(max([s for s, lack in enumerate(lacks) if lack > 0], default=0))
    ends = []
    for s, lack in enumerate(lacks):
        if lack > 0:
            at += lack
            ends.append((at, s))
    for end, s in reversed(ends):
        shard = F.when(position < F.lit(end), F.lit(s)).otherwise(shard)
    return shard.cast("int")


def propagated(linked: DataFrame, links: DataFrame, shards: int, share: float, rounds: int = ROUNDS) -> DataFrame:
    """``tag, size, shard`` of the linked rows (``tag, size``) after the rounds; ``links`` has ``tag, hub``."""
    state = linked.select("tag", "size", F.pmod(F.xxhash64(F.lit(1), "tag"), F.lit(shards)).cast("int").alias("shard"))
    state = cut_lineage(state)
    for turn in range(rounds):
        room = [QUOTA * share - used for used in by_shard(state, "shard", shards)]
        members = links.join(state, "tag")
        votes = members.groupBy("hub").agg(*[F.count(F.when(F.col("shard") == s, 1)).alias(f"v{s}") for s in range(shards)])
        heard = (
            links.join(votes, "hub")
            .groupBy("tag")
            .agg(F.min("hub").alias("first_hub"), *[F.sum(f"v{s}").alias(f"v{s}") for s in range(shards)])
        )
        rank = [F.struct(F.col(f"v{s}").alias("v"), F.xxhash64(F.lit(s), "first_hub").alias("h"), F.lit(s).alias("s")) for s in range(shards)]
        free = [rank[s] for s in range(shards) if room[s] > 0]
        if not free:
            break
        own = F.element_at(F.array(*rank), F.col("shard") + 1)
        best = F.greatest(*free) if len(free) > 1 else free[0]
        wishes = state.join(heard, "tag").select("tag", "size", "shard", F.when(best > own, best["s"]).alias("to"))
        wishes = cut_lineage(wishes)
        wanted = by_shard(wishes, "to", shards)
        if not any(wanted):
            break
        granted = F.lit(0.0)
        for s in range(shards):
            granted = F.when(F.col("to") == s, F.lit(min(1.0, max(0.0, room[s]) / max(1, wanted[s])))).otherwise(granted)
        moves = F.col("to").isNotNull() & (uniform("tag", 100 + turn) < granted)
        state = cut_lineage(wishes.select("tag", "size", F.when(moves, F.col("to")).otherwise(F.col("shard")).cast("int").alias("shard")))
    return state


def repaired(placed: DataFrame, shards: int, share: float, cells: int) -> DataFrame:
    """``placed`` (``tag, size, linked, shard``) with equal shards as far as sizes allow."""
    for turn in range(REPAIRS):
        excess = [used - share for used in by_shard(placed, "shard", shards)]
        if max(map(abs, excess)) <= TOLERANCE * share:
            break
        over = F.lit(0.0)
        for s in range(shards):
            over = F.when(F.col("shard") == s, F.lit(max(0.0, excess[s]))).otherwise(over)
        # unlinked rows come first, and small repairs take no others
        order = (F.col("linked").cast("int") + uniform("tag", 200 + turn)) / 2
        free = ~F.col("linked") | (over > LINKED_REPAIR * share)
        offered = placed.where(free & (F.col("size") <= 2 * over)).withColumn("order", order)
        leaving = running(offered, ["shard"], "order", "size", cells).where(F.col("ahead") + F.col("size") / 2 <= over)
        leaving = leaving.withColumn("line", F.lit(0)).select("tag", "size", "order", "line")
        on_line = running(leaving, ["line"], "order", "size", cells)
        to = place_on_line(F.col("ahead") + F.col("size") / 2, [-e for e in excess])
        moved = cut_lineage(on_line.select("tag", to.alias("to")))
        if moved.isEmpty():
            break
        again = placed.join(moved, "tag", "left")
        placed = cut_lineage(again.select("tag", "size", "linked", F.coalesce("to", "shard").alias("shard")))
    return placed


def balanced(rows: DataFrame, links: DataFrame, shards: int = 8, rounds: int = ROUNDS) -> DataFrame:
    """``tag, size, linked, shard`` of the rows (``tag, size``); ``links`` (``tag, hub``) may name a row in several hubs."""
    totals = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count("*").alias("n")).first()
    share, cells = totals["size"] / shards, 1 + totals["n"] // CELL_ROWS
    crowded = links.groupBy("hub").count().where("count > 1").select("hub")
    links = cut_lineage(links.join(crowded, "hub", "left_semi"))
    tags = links.select("tag").distinct().withColumn("linked", F.lit(True))
    flagged = cut_lineage(rows.join(tags, "tag", "left").select("tag", "size", F.coalesce("linked", F.lit(False)).alias("linked")))
    together = propagated(flagged.where("linked"), links, shards, share, rounds)
    lacks = [max(0.0, share - used) for used in by_shard(together, "shard", shards)]
    alone = flagged.where("not linked").withColumn("order", uniform("tag", 300)).withColumn("line", F.lit(0))
    filling = running(alone, ["line"], "order", "size", cells)
    filled = filling.select("tag", "size", "linked", place_on_line(F.col("ahead") + F.col("size") / 2, lacks).alias("shard"))
    placed = filled.unionByName(together.select("tag", "size", F.lit(True).alias("linked"), "shard"))
    return repaired(cut_lineage(placed), shards, share, cells)


def sharded(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of each row; rows of equal text are linked.

    ``slot`` numbers the rows of a shard from 0, in the order of a hash.  The law is ``bytes``: shards of nearly equal
    size; a further shard would need a new division, so ``grown_shard`` is null.
    """
    text = F.coalesce(df[f"`{text_col}`"], F.lit(""))
    narrow = df.select(
        F.monotonically_increasing_id().alias("tag"),
        df[f"`{id_col}`"].cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("hub"),
    )
    narrow = stored(narrow, "shard-rows")
    placed = balanced(narrow.select("tag", "size"), narrow.select("tag", "hub"), shards, rounds)
    cells = 1 + narrow.count() // (shards * CELL_ROWS)
    numbered = narrow.drop("hub").join(placed.select("tag", "shard"), "tag")
    numbered = numbered.withColumn("order", uniform("tag", 400)).withColumn("one", F.lit(1))
    return running(numbered, ["shard"], "order", "one", cells).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("ahead").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
