"""Mixing sources to target weights in fixed-length blocks of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.llm.common import WORD, boxed, materialise, tasks

#: Draws of sources are points of a circle of so many.
CIRCLE = 1 << 31


def _draw(*parts: Column) -> Column:
    """A pseudo-random integer of 31 bits that depends on the parts alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 8), 16, 10).cast("long") % F.lit(2147483647)


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), ceiling: int = 3) -> DataFrame:
    """source, source_size, weight, target of each source of sized(source, size).

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes; a target stops at
    ceiling times its source's size and the excess is shared again by weight. The targets are min(level * weight,
    ceiling * size): sources reach their ceiling in the order of ceiling / weight, so running sums over that order
    give the level. The table has one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (((F.row_number().over(order) - 1) % len(weights)) + 1).cast("int"))
    per = per.withColumn("weight", w.cast("double")).withColumn("top", F.lit(float(ceiling)) * F.col("source_size"))
    ratio = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("top").over(before), F.lit(0.0))
    per = per.withColumn("level", left / F.sum("weight").over(after))
    per = per.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("top"), F.col("level"))).over(whole))
    return per.select(
        "source", "source_size", "weight", F.least(F.col("top"), F.coalesce(F.col("level") * F.col("weight"), F.col("top"))).alias("target")
    )


def _laid(docs: DataFrame, block: int, lanes: int, keys: list[str]) -> DataFrame:
    """keys, doc_id, source, name, size and start, the place of a document's first word in the stream of its source.

    The words of a source form one stream, dealt in lanes (a hash of doc_id) and within a lane by doc_id. name is a
    source that is never null. Texts are read once; the table written holds numbers only.
    """
    sized = docs.select(*keys, "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = sized.withColumn("name", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))
    lane = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % lanes
    sized = materialise(sized.withColumn("lane", lane))
    held = sized.groupBy("name", "lane").agg(F.sum("size").alias("words"))
    held = held.withColumn("lane_start", F.sum("words").over(Window.partitionBy("name").orderBy("lane")) - F.col("words")).drop("words")
    inside = Window.partitionBy("name", "lane").orderBy("doc_id", *keys).rowsBetween(Window.unboundedPreceding, 0)
    laid = sized.withColumn("inside", F.sum("size").over(inside) - F.col("size")).join(held, ["name", "lane"])
    return laid.withColumn("start", F.col("inside") + F.col("lane_start")).drop("inside", "lane_start")


def drawn(goal: DataFrame, block: int, ceiling: int, shard_slots: int, seed: str) -> DataFrame:
    """name, blocks, shard, position, round, rank: the slots of the output shards and the sources drawn for them.

    A source of b blocks wants target / source_size * b slots. Output shards have m slots each, shard_slots unless that
    made fewer than 1024 shards. Slot j of a shard draws its source by weight, each slot on its own, so a shard's
    counts of sources are one multinomial draw. Slot j of the next shard turns the same draw by one S-th of the circle
    (S shards), so that over all shards a source's slots keep within about the square root of m of what it wants. The
    shards in which slot j falls to a source are then a range, found without making the others. Slots of a source are
    numbered by position and range: number n takes, in round n // b, the block of rank n % b in that round's order.
    Slots beyond ceiling rounds stay empty, and so do those past the last source.
    """
    plan = goal.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block))
    plan = plan.withColumn("wants", F.floor(F.try_divide(F.col("target"), F.col("source_size")) * F.col("blocks") * 1000 + 0.5))
    order, whole = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    plan = plan.withColumn("upto", F.sum("wants").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("slots", F.ceil(F.sum("wants").over(whole) / 1000))
    plan = plan.withColumn("m", F.greatest(F.lit(1), F.least(F.lit(shard_slots), F.expr("slots div 1024")))).withColumn("s", F.ceil(F.col("slots") / F.col("m")))
    edge = lambda x: F.floor(x.cast("double") / (F.col("m") * F.col("s") * 1000) * CIRCLE)
    plan = plan.select("name", "blocks", "m", "s", edge(F.col("upto") - F.col("wants")).alias("low"), edge(F.col("upto")).alias("high"))
    rows = plan.withColumn("position", F.explode(F.expr("sequence(0L, m - 1)")))
    rows = rows.withColumn("u", _draw(F.lit(seed), F.lit("shard"), F.col("position").cast("string")))
    turns = lambda x: F.expr(f"(({x} - u + {CIRCLE}) * s + {CIRCLE - 1}) div {CIRCLE} - s")
    rows = rows.withColumn("first", turns("low")).withColumn("n", turns("high") - F.col("first")).where("n > 0")
    before = Window.partitionBy("name").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("before", F.sum("n").over(before) - F.col("n"))
    runs = rows.withColumn("step", F.explode(F.expr("sequence(0L, (n - 1) div 4096)")))
    runs = runs.repartition(tasks(goal.sparkSession), "name", "position", "step")  # else the few rows of the plan make all slots in one task
    slots = runs.withColumn("t", F.explode(F.expr("sequence(step * 4096, least(n, (step + 1) * 4096) - 1)")))
    slots = slots.withColumn("number", F.col("before") + F.col("t")).where(F.col("number") < ceiling * F.col("blocks"))
    return slots.select(
        "name", "blocks", F.expr("pmod(first + t, s)").alias("shard"), "position", F.expr("number div blocks").alias("round"), F.expr("number % blocks").alias("rank")
    )


def permuted(rounds: DataFrame, seed: str) -> DataFrame:
    """name, round, rank, index: for each of rounds(name, blocks, round) a permutation of the block numbers.

    Blocks are ordered by a hash of seed, source, round and number. Ranks come from counts of lanes of about 16,384
    hashes, so that no task orders all blocks of a source.
    """
    runs = rounds.withColumn("step", F.explode(F.expr("sequence(0L, (blocks - 1) div 4096)")))
    runs = runs.repartition(tasks(rounds.sparkSession), "name", "round", "step")
    every = runs.withColumn("index", F.explode(F.expr("sequence(step * 4096, least(blocks, (step + 1) * 4096) - 1)")))
    every = every.withColumn("h", _draw(F.lit(seed), F.col("name"), F.col("round").cast("string"), F.col("index").cast("string")))
    every = every.withColumn("lane", F.expr(f"h * (1 + blocks div 16384) div {CIRCLE}"))
    held = every.groupBy("name", "round", "lane").agg(F.count(F.lit(1)).alias("n"))
    held = held.select("name", "round", "lane", (F.sum("n").over(Window.partitionBy("name", "round").orderBy("lane")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("name", "round", "lane").orderBy("h", "index")) - 1
    every = every.select("name", "round", "lane", "index", inside.alias("inside"))
    return every.join(held, ["name", "round", "lane"]).select("name", "round", (F.col("before") + F.col("inside")).alias("rank"), "index")


def blocks(goal: DataFrame, block: int = 32, ceiling: int = 3, shard_slots: int = 4096, seed: str = "mix") -> DataFrame:
    """shard, position, name, index: the mix as block numbers of each source's stream, by output shard and place."""
    slots = drawn(goal, block, ceiling, shard_slots, seed)
    order = permuted(slots.select("name", "blocks", "round").distinct(), seed)
    # the planner takes what comes of the few rows of the plan for small; it grows with the words, so it isn't broadcast
    return slots.join(order.hint("merge"), ["name", "round", "rank"]).select("shard", "position", "name", "index")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), ceiling: int = 3, block: int = 32, shard_slots: int = 4096, lanes: int = 1024, seed: str = "mix", key: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken; and key, a column that numbers the rows, if named.

    A source's words are cut into blocks of `block`; `drawn` gives each slot of the output shards a source by
    multinomial draws and `permuted` the block it takes. Blocks and documents meet in a join by source and block, and
    taken counts the words of the document in the blocks of the mix, repeats included: at most ceiling times its size.
    All draws are hashes of names, so reruns agree.

    A null text has size 0; a null source is a source of its own; documents without words take 0. Documents repeated
    under one doc_id are laid out after one another. Lanes keep any running sum to a share of a source, so a source
    with a third of all rows is no single task.
    """
    keys = [key] if key else []
    laid = _laid(docs, block, lanes, keys)
    goal = targets(laid, weights, ceiling).withColumn("name", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))
    times = blocks(goal, block, ceiling, shard_slots, seed).groupBy("name", "index").agg(F.count(F.lit(1)).alias("times"))
    pieces = laid.where("size > 0").withColumn("index", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    pieces = pieces.withColumn("words", F.least(F.col("start") + F.col("size"), (F.col("index") + 1) * block) - F.greatest(F.col("start"), F.col("index") * block))
    got = pieces.join(times.hint("merge"), ["name", "index"]).groupBy("name", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    full = laid.where("size > 0").join(got.hint("merge"), ["name", "start"], "left")
    every = full.select(*keys, "doc_id", "name", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    every = every.unionByName(laid.where("size = 0").select(*keys, "doc_id", "name", "size", F.lit(0).cast("long").alias("taken")))
    return every.join(goal.select("name", "source_size", "target"), "name").select(*keys, "doc_id", "size", "source_size", "target", "taken")


@boxed
def repeat(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), ceiling: int = 3, seed: str = "mix") -> DataFrame:
    """docs with each row as often as the mix takes it; all columns stay.

    A document of which the mix takes taken words of size appears floor(taken / size) times, and once more with the
    probability of the fraction left, by a hash of its doc_id and text: never over ceiling times. Rows without words
    go. Rows are numbered in a table written first and meet their count by that number, so ids may be null or repeated.
    """
    rows = materialise(docs.withColumn("_row", F.monotonically_increasing_id()))
    chance = _draw(F.lit(seed), F.lit("copy"), F.col("doc_id").cast("string"), F.md5("text")) / F.lit(2147483647.0)
    draws = rows.select(F.col("_row"), chance.alias("chance"))
    mixed = mix(rows, weights, ceiling, seed=seed, key="_row").where("taken > 0").join(draws, "_row")
    copies = mixed.select("_row", F.least(F.lit(ceiling), F.floor(F.try_divide(F.col("taken"), F.col("size")) + F.col("chance"))).cast("int").alias("_copies")).where("_copies > 0")
    return rows.join(copies, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
