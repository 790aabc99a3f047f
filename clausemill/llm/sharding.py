"""Balanced label propagation: documents move to the shards of the documents they are linked with, under quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.llm.common import materialise, release

#: Moves are let through by these many steps of priority, slots are numbered in these many lanes of a shard, and rows of
#: a group meet what is known of it under these many names.
STEPS, LANES, SALTS = 1024, 256, 256


def _mod(n: int, *parts: Column | str) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(n))


def propagate(members: DataFrame, shards: int, capacity: int, rounds: int = 3) -> DataFrame:
    """members(row, grp, salt, label) with labels moved towards those of their group.

    Each round counts the labels of every group (summed by task first), ranks them, and gives the group as many home
    shards as its size needs: one, unless it is larger than a shard. A row outside its group's homes wants to move to
    one of them. From shard i to shard j as many rows may move as want to move back, plus j's share of free capacity;
    a group's rows have one priority, so they pass or wait together. The quota tables have shards x shards x STEPS
    rows at most, whatever the input. Rows meet their group's homes by group and salt, so a group that holds a third of
    all rows is SALTS keys. Rounds end early once no row moves.
    """
    state, names, before = members, materialise(members.select("grp", "salt").distinct()), None
    for turn in range(rounds):
        tally = state.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n"))
        by = Window.partitionBy("grp")
        ranked = tally.withColumn("size", F.sum("n").over(by)).withColumn(
            "rank", F.row_number().over(by.orderBy(F.desc("n"), _mod(1 << 30, "grp", "label", F.lit(turn))))
        )
        homes = ranked.withColumn("k", F.least(F.lit(shards), F.ceil(F.col("size") / max(1, capacity))).cast("int")).where("rank <= k")
        homes = homes.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("rank", "label"))).alias("homes"))
        aimed = state.join(homes.join(names, "grp"), ["grp", "salt"])
        pick = (_mod(1 << 30, "row") % F.size("homes") + 1).cast("int")
        there = F.exists("homes", lambda x: x["label"] == F.col("label"))
        aimed = aimed.select("row", "grp", "salt", "label", F.when(there, F.col("label")).otherwise(F.element_at("homes", pick)["label"]).alias("aim"), F.size("homes").alias("k"))
        step = F.when(F.col("k") == 1, _mod(STEPS, "grp", F.lit(turn))).otherwise(_mod(STEPS, "row"))
        aimed = aimed.withColumn("step", step)
        wants = aimed.where("aim <> label").groupBy("label", "aim", "step").agg(F.count(F.lit(1)).alias("n"))
        loads = state.groupBy("label").agg(F.count(F.lit(1)).alias("load"))
        flow = wants.groupBy("label", "aim").agg(F.sum("n").alias("w"))
        back = flow.select(F.col("label").alias("aim"), F.col("aim").alias("label"), F.col("w").alias("b"))
        room = flow.join(back, ["label", "aim"], "left").join(loads.withColumnRenamed("label", "aim"), "aim", "left")
        free = F.greatest(F.lit(0), F.lit(capacity) - F.coalesce("load", F.lit(0)))
        over = Window.partitionBy("aim")
        one_way = F.col("w") - F.least(F.col("w"), F.coalesce("b", F.lit(0)))
        room = room.withColumn("quota", F.least(F.col("w"), F.coalesce("b", F.lit(0))) + F.floor(free * one_way / F.greatest(F.lit(1), F.sum(one_way).over(over))))
        upto = Window.partitionBy("label", "aim").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
        passed = wants.withColumn("upto", F.sum("n").over(upto)).join(room.select("label", "aim", "quota"), ["label", "aim"])
        passed = passed.where("upto <= quota").select("label", "aim", "step", F.lit(True).alias("go"))
        state = aimed.join(F.broadcast(passed), ["label", "aim", "step"], "left").select(
            "row", "grp", "salt", F.when(F.col("go"), F.col("aim")).otherwise(F.col("label")).alias("label"), F.coalesce("go", F.lit(False)).alias("moved")
        )
        moved = materialise(state)
        if before is not None:
            release(before)
        before, state = moved, moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    return state


def level(rows: DataFrame, shards: int) -> DataFrame:
    """rows(row, grp, label) with shard and slot: shard sizes differ by one at most and slots have no gaps.

    Rows are numbered within their label, linked ones first and by group; numbers come from counts of lanes, so no
    task sees a whole shard. The rows that are over a shard's size go, in order, to the places left elsewhere.
    """
    lane = F.when(F.col("grp").isNull(), LANES * 16 + _mod(LANES * 16, "row")).otherwise(_mod(LANES, "grp") * 16 + _mod(16, "row"))
    rows = rows.withColumn("lane", lane)
    numbered = _number(rows, ["label"])
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    every = sizes.sparkSession.range(shards).select(F.col("id").cast("int").alias("label"))
    quota = every.join(sizes, "label", "left").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy())
    quota = quota.withColumn("quota", F.floor(total / shards) + F.when(F.col("label") < total % shards, 1).otherwise(0))
    quota = quota.withColumn("gap", F.greatest(F.lit(0), F.col("quota") - F.col("n")))
    quota = quota.withColumn("gap_end", F.sum("gap").over(Window.orderBy("label").rowsBetween(Window.unboundedPreceding, 0)))
    quota = quota.select("label", "quota", "n", (F.col("gap_end") - F.col("gap")).alias("gap_start"), "gap_end")
    placed = numbered.join(F.broadcast(quota.select("label", "quota")), "label")
    stay = placed.where("number < quota").select("row", "grp", F.col("label").alias("shard"), F.col("number").alias("slot"))
    spare = placed.where("number >= quota").select("row", "grp", F.lit(0).alias("label"), F.pmod(F.xxhash64("row"), F.lit(LANES * 16)).alias("lane"))
    spare = _number(spare, ["label"]).drop("label")
    to = F.broadcast(quota.where("gap_end > gap_start"))
    moved = spare.join(to, (F.col("number") >= F.col("gap_start")) & (F.col("number") < F.col("gap_end"))).select(
        "row", "grp", F.col("label").alias("shard"), (F.col("n") + F.col("number") - F.col("gap_start")).alias("slot")
    )
    return stay.unionByName(moved)


def _number(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with a gapless number from 0 within keys, in the order of lane, grp, row."""
    lanes = rows.groupBy(*keys, "lane").agg(F.count(F.lit(1)).alias("held"))
    lanes = lanes.withColumn("before", F.sum("held").over(Window.partitionBy(*keys).orderBy("lane")) - F.col("held")).drop("held")
    inside = F.row_number().over(Window.partitionBy(*keys, "lane").orderBy(F.col("grp").asc_nulls_last(), "row")) - 1
    return rows.withColumn("inside", inside).join(lanes, [*keys, "lane"]).withColumn("number", F.col("inside") + F.col("before")).drop("inside", "before", "lane")


def shard_rows(docs: DataFrame, shards: int = 24, rounds: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law "rows", shard, slot, grown_shard (null).

    Equal texts are linked. All rows start at a shard given by a hash; label propagation then gathers linked rows
    while no shard may hold more of them than an even share; levelling with the unlinked rows leaves sizes at most one
    apart. A group larger than a shard is spread over as few shards as can hold it.

    size is the UTF-8 length plus 8; a null text has 8 bytes, CRC 0 and is equal to the empty text. Rows that repeat a
    doc_id are placed each on its own. An empty table gives no rows. Only hashes, never texts, are shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text).alias("grp"),
    )
    base = materialise(base.withColumn("row", F.struct("doc_id", F.monotonically_increasing_id().alias("nth"))))
    total = base.count()
    rows = base.select("row", "grp", _mod(SALTS, "row").cast("int").alias("salt"), _mod(shards, "row").cast("int").alias("label"))
    sizes = rows.groupBy("grp", "salt").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("grp", "salt", F.sum("n").over(Window.partitionBy("grp")).alias("held"))
    rows = materialise(rows.join(sizes, ["grp", "salt"]))
    members = rows.where("held > 1").select("row", "grp", "salt", "label")
    single = rows.where("held = 1").select("row", F.lit(None).cast("string").alias("grp"), "label")
    moved = propagate(members, shards, total // shards, rounds).drop("salt")
    placed = level(moved.unionByName(single), shards)
    facts = base.select("row", "size", "text_crc32")
    return placed.join(facts, "row").select(
        F.col("row.doc_id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
