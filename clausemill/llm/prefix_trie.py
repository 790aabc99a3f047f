"""The trie of conversation prefixes, from whole sequences that are collapsed first."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.llm.common import materialise, tasks

#: Key of the empty sequence; parts of a node's children in a join; characters of ids in one piece of an end list.
ROOT, SALTS, PIECE = b"\0" * 16, 16, 1 << 16


def head_length(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its five: the CRC-32 of its decimal id, modulo 9."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 9).cast("int")


def rebuild(conversations: DataFrame) -> DataFrame:
    """conv_id, i, digest, n_bytes: the rebuilt turns of every conversation, i from 1, and a row of i = 0 for each one.

    A conversation c is the first h turns of conversation c - c % 5 (all if that has fewer, none if it is absent) and
    then its own after its first h; h is head_length. Turns go by turn (null first), ties by digest; digest stands for
    role and text, n_bytes is the text's size in UTF-8. No text is shuffled: a turn goes to at most five conversations as
    16 bytes. Rows with a null conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "digest"))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    rows = materialise(rows.select("conv_id", nth.alias("i"), "digest", "n_bytes"))
    tops = rows.where("i = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), head_length(F.col("conv_id")).alias("h"))
    own = rows.where(F.col("i") > head_length(F.col("conv_id")))
    lent = rows.where("i <= 8 and conv_id % 5 = 0").withColumnRenamed("conv_id", "base")
    taken = tops.join(lent, "base").where("i <= h").select("conv_id", "i", "digest", "n_bytes")
    start = tops.select("conv_id", F.lit(0).alias("i"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("n_bytes"))
    return start.unionByName(taken).unionByName(own)


def chain(rebuilt: DataFrame) -> DataFrame:
    """conv_id, depth, key, parent, n_bytes, ends: every prefix of every conversation, named by a hash chained from turn to
    turn; ends tells the whole conversation. Turns are streamed past in order, one conversation after the other."""
    kind = dict(rebuilt.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        names = ["conv_id", "depth", "key", "parent", "n_bytes", "ends"]
        for batch in batches:
            out = []
            types = [batch.schema.field(0).type, pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
            for c, i, digest, n in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "i", "digest", "n_bytes")), strict=True):
                if held is not None:
                    out.append((*held, i == 0))
                if i == 0:
                    held = (c, 0, ROOT, None, 0)
                else:
                    held = (c, held[1] + 1, hashlib.md5(held[2] + digest).digest(), held[2], n)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*held, True), types, strict=True)], names)

    ordered = rebuilt.repartition("conv_id").sortWithinPartitions("conv_id", "i")
    return ordered.mapInArrow(run, f"conv_id {kind}, depth int, key binary, parent binary, n_bytes long, ends boolean")


def end_lists(ends: DataFrame) -> DataFrame:
    """key, ends_sha256 of ends(key, conv_id): the SHA-256 of each key's ids in ascending order, joined by commas.

    A list may be as long as the table. Ids are dealt by ranges of key and id over all tasks, which join them to pieces
    of PIECE characters; only pieces meet by key, in order, and the hash runs over them as they come.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, first = None, [], None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)])], ["key", "first", "piece"])

        size = 0
        for batch in batches:
            for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if ids and (k != key or size > PIECE):
                    yield told()
                    ids, size = [], 0
                if not ids:
                    key, first = k, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if ids:
            yield told()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out])], ["key", "ends_sha256"])
        for batch in batches:
            for k, piece in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                if k == key:
                    state.update(b"," + piece.encode())
                else:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(piece.encode())
            if len(out) > 10_000:
                yield batch_of()
                out = []
        if state is not None:
            out.append((key, state.hexdigest()))
        if out:
            yield batch_of()

    parts = tasks(ends.sparkSession)
    made = ends.select("key", F.col("conv_id").cast("long")).repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(pieces, "key binary, first long, piece string")
    return made.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key binary, ends_sha256 string")


def sequences(prefixes: DataFrame) -> DataFrame:
    """key, rep, weight, leaf of each distinct whole sequence of chain(): its smallest conversation, how many are equal to
    it, and whether no other begins with it (it is no proper prefix, by anti-join)."""
    whole = prefixes.where("ends").groupBy("key").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    proper = prefixes.where("parent is not null").select(F.col("parent").alias("key")).distinct()
    leaves = whole.join(proper, "key", "left_anti").select("key", F.lit(1).alias("leaf"))
    return whole.join(leaves, "key", "left").na.fill(0, ["leaf"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are rebuilt (see there) and equal ones collapse to one weighted sequence. A node, a distinct sequence of
    first turns, sums the weights and leaves of the sequences that begin with it, and is named by its depth and the
    smallest conversation in it; the sequence of that conversation owns the node. A sequence owns the lower end of its
    path, so only its topmost own node has to look its parent up, and what nodes save is summed up along each sequence
    from the bottom, own nodes only, and then by node: every node below counts once. Work is linear in turns.

    Groups by key are summed up in each task first. Parents with many children meet them in SALTS parts. A null role or
    text is empty; rows with a null conv_id are left out; other columns are left out; empty tables give no rows.
    """
    prefixes = materialise(chain(rebuild(conversations)))
    found = materialise(sequences(prefixes))
    kept = found.select(F.col("rep").alias("conv_id"), "weight", "leaf")
    paths = materialise(prefixes.join(kept, "conv_id").select("conv_id", "depth", "key", "parent", "n_bytes", "weight", "leaf"))
    nodes = paths.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"),
        F.first("depth").alias("depth"),
        F.first("parent").alias("parent"),
        F.first("n_bytes").alias("n_bytes"),
        F.sum("weight").alias("n_convs"),
        F.sum("leaf").alias("n_leaves"),
        F.count(F.lit(1)).alias("n_sequences"),
    )
    nodes = materialise(nodes)

    # what each node saves, along the paths from the bottom
    own = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saves"))
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = paths.select("conv_id", "depth", "key").join(own, ["conv_id", "depth"], "left").select("key", F.sum(F.coalesce("saves", F.lit(0))).over(below).alias("saved"))

    # parents: of a conversation's topmost own node by key, of its other own nodes the conversation itself
    top = F.lag("depth").over(Window.partitionBy("conv_id").orderBy("depth")).isNull()
    placed = nodes.select("key", "parent", "conv_id", "depth", top.alias("top"))
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")
    parents = nodes.where("n_sequences > 1").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    upward = placed.where("top and depth > 0").withColumn("salt", salt).join(parents, ["parent", "salt"]).select("key", "parent_conv_id")
    upward = upward.unionByName(placed.where("not top").select("key", F.col("conv_id").alias("parent_conv_id")))

    # all facts of a node meet by its key
    named = ["conv_id", "depth", "n_convs", "n_leaves"]
    parts = [
        nodes.select("key", *named),
        upward,
        nodes.where("parent is not null").select(F.col("parent").alias("key"), F.lit(1).cast("long").alias("n_children")),
        summed,
        end_lists(prefixes.where("ends").select("key", "conv_id")),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    met = every.groupBy("key").agg(
        *[F.max(c).alias(c) for c in (*named, "parent_conv_id", "ends_sha256")],
        F.coalesce(F.sum("n_children"), F.lit(0)).alias("n_children"),
        F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"),
    )
    none = hashlib.sha256(b"").hexdigest()
    long = lambda c: F.col(c).cast("long").alias(c)
    return met.select(*map(long, ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
