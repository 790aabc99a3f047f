"""Removal of repeated passages by fixed-block anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.common import WordHash, id_text, materialise, release, tasks

#: Bytes of text in a chunk (a run of doc_ids that one task reads at a time) and words in a bucket of hashes, about.
CHUNK_BYTES, BUCKET_WORDS = 8 << 20, 2_000_000
_M1, _M2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


_HASH = WordHash()


def rolling(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of the `size` words from each position on, by doubling; positions too near the end are left out."""
    mod = (1 << 64) - 1
    out, length, span, width = None, 0, h, 1
    while True:
        if size & width:
            if out is None:
                out, length = span, width
            else:
                n = len(h) - length - width + 1
                out = span[:n] * np.uint64(pow(base, length, 1 << 64) & mod) + out[width : width + n] if n > 0 else h[:0]
                length += width
        if length == size:
            return out
        n = len(h) - 2 * width + 1
        span = span[:n] * np.uint64(pow(base, width, 1 << 64) & mod) + span[width : width + n] if n > 0 else h[:0]
        width *= 2


class _Chunk:
    """The documents of a chunk in order of doc_id, with the hash of each word."""

    def __init__(self, table: pa.Table, window: int):
        ids, texts = table.column("doc_id").to_pylist(), table.column("text").cast(pa.binary()).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
        self.ids, self.words = [ids[i] for i in order], [texts[i].split() for i in order]
        self.sizes = np.array([len(x) for x in self.words], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        every = [w for x in self.words for w in x]
        self.h = np.fromiter(map(_HASH.__getitem__, every), np.uint64, len(every))
        self.block = (window + 1) // 2
        self.window = window
        self.left = np.repeat(self.starts[1:], self.sizes) - np.arange(len(every))  # words from here to the document's end
        self.nth = np.arange(len(every)) - np.repeat(self.starts[:-1], self.sizes)

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, hashes and alignment of every rolling block; aligned ones are the reference blocks."""
        got = rolling(self.h, self.block, _M1)
        at = np.flatnonzero(self.left[: len(got)] >= self.block)
        return at, got[at], self.nth[at] % self.block == 0

    def anchored(self, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows whose reference blocks are all hits: positions and two hashes.

        A window of 2 * block - 1 words or more holds a whole reference block, and one that is repeated elsewhere has
        its reference blocks repeated there too.
        """
        at, h, aligned = self.blocks()
        cold = np.zeros(len(self.h) + 1, np.int64)
        cold[at[aligned & ~hit]] = 1
        cold = np.concatenate(([0], np.cumsum(cold)))
        n = len(self.h) - self.window + 1
        if n <= 0:
            return at[:0], h[:0], h[:0]
        last = self.window - self.block + 1
        ok = (self.left[:n] >= self.window) & (cold[last : n + last] == cold[:n])
        other = (self.h ^ (self.h >> np.uint64(29))) * np.uint64(_M2)
        at = np.flatnonzero(ok)
        return at, rolling(self.h, self.window, _M1)[at], rolling(other, self.window, _M2)[at] >> np.uint64(32)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _parcels(chunk: int, h: np.ndarray, buckets: int) -> tuple[np.ndarray, list[int]]:
    """Sorted distinct hashes fall into runs by bucket: the bounds of the runs."""
    return np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1))


_SENT = "bucket int, chunk string, hashes binary, more binary"
_REPLY = "chunk string, bucket int, bits binary"


def _sent(chunk: str, bounds: np.ndarray, hashes: np.ndarray, more: list[bytes]) -> pa.Table:
    full = np.flatnonzero(np.diff(bounds))
    return pa.table(
        {
            "bucket": pa.array(full, pa.int32()),
            "chunk": pa.array([chunk] * len(full), pa.string()),
            "hashes": pa.array([hashes[bounds[i] : bounds[i + 1]].tobytes() for i in full], pa.binary()),
            "more": pa.array([more[i] for i in full], pa.binary()),
        }
    )


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted array: whether each element begins a run, and the number of its run."""
    new = np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1]))
    return new, np.cumsum(new) - 1


def _reply(chunks: list[str], bucket: int, cuts: np.ndarray, bits: np.ndarray) -> pa.Table:
    return pa.table(
        {
            "chunk": pa.array(chunks, pa.string()),
            "bucket": pa.array([bucket] * len(chunks), pa.int32()),
            "bits": pa.array([np.packbits(bits[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
        }
    )


def _ordered(table: pa.Table) -> tuple[list[str], list[bytes], list[bytes]]:
    rows = sorted(zip(table.column("chunk").to_pylist(), table.column("hashes").to_pylist(), table.column("more").to_pylist()))
    return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]


def _answers(replies: pa.Table, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros(int(bounds[-1]), bool)
    for bucket, bits in zip(replies.column("bucket").to_pylist(), replies.column("bits").to_pylist()):
        a, b = bounds[bucket], bounds[bucket + 1]
        out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(b - a)).astype(bool)
    return out


def chunked(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows(doc_id, text) with chunk, a name, and the bytes of all texts; names sort as their doc_ids do, null first.

    Chunks are ranges of doc_id of equal width, and a range that holds over 3 * CHUNK_BYTES is cut again, between its
    own smallest and largest doc_id, until none does; where all rows have one doc_id (or none) it is cut by a hash of
    the text. So a chunk's size follows the bytes and not the spread of the ids; only a single text, or copies of one
    under one doc_id, may be larger.
    """
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 1))
    light = materialise(rows.select("doc_id", "h", F.octet_length("text").alias("bytes")))
    low, high, size = (x or 0 for x in light.agg(F.min("doc_id"), F.max("doc_id"), F.sum("bytes")).first())
    parts = max(1, size // CHUNK_BYTES)
    number = lambda x: F.lpad(F.hex(x.cast("long")), 8, "0")
    cell = F.when(F.col("doc_id").isNull(), 0).otherwise(1 + F.floor((F.col("doc_id") - F.lit(low)) / F.lit(-(-(high - low + 1) // parts))))
    rows, before, light = rows.withColumn("chunk", number(cell)), light, materialise(light.withColumn("chunk", number(cell)))
    release(before)
    while True:
        ends = [f("doc_id") for f in (F.min, F.max)] + [f("h") for f in (F.min, F.max)]
        large = light.groupBy("chunk").agg(F.sum("bytes").alias("b"), *(e.alias(c) for e, c in zip(ends, ("low", "high", "h_low", "h_high"))))
        large = materialise(large.where(F.col("b") > 3 * CHUNK_BYTES).where("low < high or h_low < h_high"))
        if large.isEmpty():
            release(light)
            release(large)
            return rows.drop("h"), size

        def finer(x: DataFrame) -> DataFrame:
            by_id = F.col("low") < F.col("high")
            at = F.when(by_id, F.col("doc_id") - F.col("low")).otherwise(F.col("h") - F.col("h_low"))
            span = F.when(by_id, F.col("high") - F.col("low")).otherwise(F.col("h_high") - F.col("h_low"))
            part = F.floor(at.cast("double") * F.ceil(F.col("b") / CHUNK_BYTES) / (span.cast("double") + 1))
            cut = x.join(F.broadcast(large), "chunk", "left")
            return cut.withColumn("chunk", F.when(F.col("b").isNull(), F.col("chunk")).otherwise(F.concat("chunk", F.lit("."), number(part)))).select(*x.columns)

        rows, before, light = finer(rows), light, materialise(finer(light))
        release(before)


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text (kept words joined by one space).

    A word goes if a window of `window` words covers it whose word sequence also starts earlier: in a document with a
    smaller doc_id, or earlier in the same one. Windows are judged on the input.

    Documents are dealt to chunks, runs of doc_ids of about CHUNK_BYTES. (1) Every chunk indexes its reference blocks,
    which do not overlap, and probes with every rolling block: it sends the distinct 32-bit hashes by bucket and gets
    one bit back for each reference block, whether its words occur twice. (2) Windows whose reference blocks are all
    hits are extended to whole windows: a chunk sends their distinct 96-bit hashes, and gets back whether a smaller
    chunk has the window; inside the chunk the first occurrence is seen directly. Windows found so overlap into the
    maximal repeats, which are cut out. A passage sends one hash per chunk, however often it occurs, and no pairs of
    documents are made. The text is shuffled once; the three passes read the same exchange.

    Null and empty texts have 0 words and an empty kept_text. Rows that repeat a doc_id are ordered by their text
    (in a chunk cut by hash, by the hash first); the second is then a repeat of the first. Null doc_ids come before all others. An empty table gives no rows.
    """
    rows = id_text(docs)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    rows, size = chunked(rows)
    dealt = max(tasks(spark), size // (4 * CHUNK_BYTES))
    buckets = max(1, size // (6 * BUCKET_WORDS))
    chunks = rows.repartition(dealt, "chunk")

    def distinct(c: _Chunk) -> tuple[np.ndarray, ...]:
        """Distinct block hashes in order, whether each is a reference block and whether it occurs twice here."""
        at, h, aligned = c.blocks()
        h = (h ^ (h >> np.uint64(31))) * np.uint64(_M2)
        h = ((_bucket(h, buckets).astype(np.uint64)) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        order = np.argsort(h)
        new, run = _runs(h[order])
        index = np.zeros(len(h), bool)
        first = np.flatnonzero(new)
        ref = np.logical_or.reduceat(aligned[order], first) if len(first) else index[:0]
        multi = np.diff(np.append(first, len(h))) > 1
        where = np.empty(len(h), np.int64)
        where[order] = run
        bounds = np.searchsorted(h[order][first] >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
        return (h[order][first] & np.uint64(0xFFFFFFFF)).astype(np.uint32), ref, multi, where, bounds

    def probe(key: tuple, table: pa.Table) -> pa.Table:
        h, ref, multi, _, bounds = distinct(_Chunk(table, window))
        flags = [np.packbits(ref[a:b]).tobytes() + np.packbits(multi[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        return _sent(key[0].as_py(), bounds, h, flags)

    def match(key: tuple, table: pa.Table) -> pa.Table:
        ids, blobs, more = _ordered(table)
        each = [np.frombuffer(x, np.uint32) for x in blobs]
        cuts = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64)
        bits = [np.unpackbits(np.frombuffer(m, np.uint8).reshape(2, -1), axis=1, count=len(x)).astype(bool) for m, x in zip(more, each)]
        h, multi = np.concatenate(each), np.concatenate([b[1] for b in bits])
        order = np.argsort(h)
        new, run = _runs(h[order])
        twice = np.bincount(run, weights=1 + multi[order]) > 1
        out = np.empty(len(h), bool)
        out[order] = twice[run]
        return _reply(ids, key[0].as_py(), cuts, out)

    def windows(c: _Chunk, replies: pa.Table) -> tuple[np.ndarray, ...]:
        """Anchored windows: positions, distinct hashes in order, which distinct one each is, which come first here."""
        _, _, _, where, bounds = distinct(c)
        at, h1, h2 = c.anchored(_answers(replies, bounds)[where])
        order = np.argsort(h1, kind="stable")
        a, b = h1[order], h2[order]
        if np.any((a[1:] == a[:-1]) & (b[1:] != b[:-1])):
            order = np.lexsort((np.arange(len(h1)), h2, h1))
            a, b = h1[order], h2[order]
        new = np.concatenate((np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        first = np.zeros(len(a), bool)
        first[order[new]] = True
        where = np.empty(len(a), np.int64)
        where[order] = np.cumsum(new) - 1
        return at, a[new], b[new].astype(np.uint32), where, first, _parcels(0, a[new], buckets)

    def extend(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _sent("", np.zeros(1, np.int64), np.zeros(0, np.uint64), [])
        _, h1, h2, _, _, bounds = windows(_Chunk(table, window), replies)
        return _sent(key[0].as_py(), bounds, h1, [h2[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])])

    def earlier(key: tuple, table: pa.Table) -> pa.Table:
        ids, blobs, more = _ordered(table)
        each = [np.frombuffer(x, np.uint64) for x in blobs]
        cuts = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64)
        h1, h2 = np.concatenate(each), np.concatenate([np.frombuffer(x, np.uint32) for x in more])
        order = np.argsort(h1, kind="stable")  # chunks are in order, so the first of a run is the earliest
        if np.any((h1[order][1:] == h1[order][:-1]) & (h2[order][1:] != h2[order][:-1])):
            order = np.lexsort((np.arange(len(h1)), h2, h1))
        a, b = h1[order], h2[order]
        out = np.zeros(len(h1), bool)
        out[order[1:]] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        return _reply(ids, key[0].as_py(), cuts, out)

    out_schema = f"doc_id {id_type}, n_words long, n_removed long, kept_text string"

    def cut(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        first_round = replies.filter(pa.compute.equal(replies.column("round"), 1))
        second_round = replies.filter(pa.compute.equal(replies.column("round"), 2))
        if not table.num_rows:
            return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string())})
        c = _Chunk(table, window)
        at, _, _, where, first, bounds = windows(c, first_round)
        gone = at[_answers(second_round, bounds)[where] | ~first]
        cover = np.zeros(len(c.h) + 1, np.int64)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + window, -1)
        out = np.cumsum(cover)[: len(c.h)] > 0
        kept, removed = [], []
        for words, a, b in zip(c.words, c.starts[:-1].tolist(), c.starts[1:].tolist()):
            off = out[a:b]
            removed.append(int(off.sum()))
            kept.append(b" ".join(words if not removed[-1] else [w for w, o in zip(words, off.tolist()) if not o]))
        return pa.table(
            {
                "doc_id": pa.array(c.ids, table.schema.field("doc_id").type),
                "n_words": pa.array(c.sizes),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    by_chunk = chunks.groupBy("chunk")
    hits = by_chunk.applyInArrow(probe, _SENT).repartition(dealt, "bucket").groupBy("bucket").applyInArrow(match, _REPLY)
    again = by_chunk.cogroup(hits.repartition(dealt, "chunk").groupBy("chunk")).applyInArrow(extend, _SENT)
    seen = again.repartition(dealt, "bucket").groupBy("bucket").applyInArrow(earlier, _REPLY)
    both = hits.withColumn("round", F.lit(1)).unionByName(seen.withColumn("round", F.lit(2)))
    return by_chunk.cogroup(both.repartition(dealt, "chunk").groupBy("chunk")).applyInArrow(cut, out_schema)
