"""Names that contents give: digests, snapshot ids, name-based UUIDs and canonical JSON."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The namespace of domain names. Fixed value.
DNS = "6ba7b8109dad11d180b400c04fd430c8"
#: Bytes of text in one piece of a digest.
PIECE = 1 << 20


def ordered_digest(rows: DataFrame, key: str, order: list[str], text: Column) -> DataFrame:
    """key, digest: the SHA-256 of a group's texts one after the other, by order.

    The value is that of one hash over all, and a group may be as large as the table: rows are sorted by ranges of key and
    order over all tasks, which put them together to pieces; only pieces meet by key, in order, and are hashed as they
    come. Equal orders go by text. Null texts are empty; a null key is a group.
    """
    spark, kind = rows.sparkSession, dict(rows.dtypes)[key]
    some = rows.select(F.col(key).alias("key"), F.struct(*order).alias("place"), F.coalesce(text, F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = some.repartitionByRange(parts, "key", "place", "text").sortWithinPartitions("key", "place", "text").select("key", F.spark_partition_id().alias("part"), "text")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_type, now, part, held, size, nth = None, None, 0, [], 0, 0
        told = lambda: pa.RecordBatch.from_arrays([pa.array([now], key_type), pa.array([part], pa.int32()), pa.array([nth], pa.int64()), pa.array(["".join(held)])], ["key", "part", "nth", "text"])
        for batch in batches:
            key_type = batch.schema.field("key").type
            for k, p, x in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "text")), strict=True):
                if held and (k != now or size > PIECE):
                    yield told()
                    held, size, nth = [], 0, nth + 1
                now, part = k, p
                held.append(x)
                size += len(x)
        if held:
            yield told()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_type, now, state, out = pa.int64(), None, None, []
        for batch in batches:
            key_type = batch.schema.field("key").type
            for k, x in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if state is None or k != now:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state = k, hashlib.sha256()
                state.update(x.encode())
        if state is not None:
            out.append((now, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], key_type), pa.array([d for _, d in out], pa.string())], ["key", "digest"])

    made = sorted_rows.mapInArrow(pieces, f"key {kind}, part int, nth long, text string").repartition("key").sortWithinPartitions("key", "part", "nth")
    return made.mapInArrow(hashed, f"key {kind}, digest string").withColumnRenamed("key", key)


def unit_digest(units: DataFrame, key: str) -> DataFrame:
    """key, digest over `locator` and `content_hash` of units, a line each, sorted."""
    line = F.concat(F.coalesce("locator", F.lit("")), F.lit("\n"), F.coalesce("content_hash", F.lit("")), F.lit("\n"))
    return ordered_digest(units, key, ["locator", "content_hash"], line)


def space(model: Column, width: Column, provider: Column) -> Column:
    """What names an embedding space, a line each."""
    return F.concat_ws("\n", model, width.cast("string"), provider)


def space_fingerprint(spec: Column) -> Column:
    return F.substring(F.sha2(spec, 256), 1, 16)


def collection_name(prefix: str, manifest_hash: Column, spec: Column, policy: Column) -> Column:
    """The table that a corpus specification builds: <prefix>_ and 16 digits."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\n", manifest_hash, spec, policy), 256), 1, 16))


def snapshot_id(manifest_hash: Column, digest: Column, spec: Column, policy: Column) -> Column:
    """A corpus by what is in it and not by when it was built."""
    return F.substring(F.sha2(F.concat_ws("\n", manifest_hash, digest, spec, policy), 256), 1, 24)


def uuid5(name: Column, namespace: str = DNS) -> Column:
    """The name-based UUID of a text: SHA-1 of the namespace and the text, with the bits of version 5 and its variant."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    at = lambda i, n: F.substring(h, i + 1, n)
    variant = F.translate(at(16, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", at(0, 8), at(8, 4), F.concat(F.lit("5"), at(13, 3)), F.concat(variant, at(17, 3)), at(20, 12))


def canonical_json(body: Column, ascii_only: bool = False) -> Column:
    """A JSON text with the keys of all its objects sorted, a space after commas and colons, null if it is none.

    As variants hold objects by sorted keys, one parse sorts them at every depth. ascii_only: other characters become \\u
    escapes, pairs of them beyond the first plane. Whole numbers and decimals stay as they are written; ones with an exponent
    are doubles.
    """
    parts = F.regexp_extract_all(F.to_json(F.try_parse_json(body)), F.lit(r'("(?:[^"\\]|\\.)*"|[^"]+)'), F.lit(1))
    four = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    pair = lambda n: F.concat(four(F.shiftright(n - 0x10000, 10) + 0xD800), four((n - 0x10000) % 1024 + 0xDC00))
    one = lambda c: F.when(F.ascii(c) < 127, c).when(F.ascii(c) < 0x10000, four(F.ascii(c))).otherwise(pair(F.ascii(c)))
    coded = lambda x: F.when(x.rlike(r"[^\x00-\x7e]"), F.array_join(F.transform(F.split(x, ""), one), "")).otherwise(x) if ascii_only else x
    spaced = lambda x: F.when(x.startswith('"'), coded(x)).otherwise(F.replace(F.replace(x, F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": ")))
    return F.array_join(F.transform(parts, spaced), "")


def config_fingerprint(body: Column, ascii_only: bool = True) -> Column:
    """The SHA-256 of the canonical JSON of a record."""
    return F.sha2(canonical_json(body, ascii_only), 256)
