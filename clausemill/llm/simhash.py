"""SimHash fingerprints and near-duplicate groups by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.common import WordHash, boxed, id_text, materialise, runs, small, tasks, texts
from clausemill.llm.graph import components

BITS = 64
#: The similarity stage: two words of 64 bits, each cut into blocks of 32 bits with their own masks of radius 4; texts
#: whose 128 bits differ in at most NEAR are candidates. At a similarity of 0.8 about 19.4 bits differ (deviation 4.1).
BLOCK, BLOCK_RADIUS, NEAR = 32, 4, 36
#: Bytes of shingles (8 each) that one task holds of a group of candidates at a time.
GROUP_BYTES = 16 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_HASH = WordHash()


def fingerprint(text: bytes, words: int = 4) -> int:
    """The SimHash of a text's shingles, repeats included: a bit is 1 if set in over half of the shingles' hashes."""
    import xxhash

    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    hashed = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return hashed(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(parts) - words + 1
    counts = np.zeros(BITS, np.int64)
    starts, ends = starts[:n].tolist(), ends[words - 1 :].tolist()
    for at in range(0, n, 1 << 15):
        got = np.array([hashed(joined[a:b], 42) for a, b in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)])], "<u8")
        counts += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp (64 bits as a signed long) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            got = np.array([fingerprint(x, words) for x in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got)], ["doc_id", "fp"])

    rows = id_text(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def covering_masks(radius: int, bits: int = BITS, seed: int = 7) -> list[int]:
    """2^(radius+1) - 1 masks such that any two words within the radius agree on all bits of some mask.

    Each bit gets a vector of radius + 1 bits; mask v holds the bits whose vector has an odd product with v. The at
    most radius bits in which two words differ pose at most radius linear conditions on v, so a v other than 0 meets
    them all, and its mask holds none of those bits.
    """
    rng = np.random.default_rng(seed)
    vectors = (rng.permutation(bits) % ((1 << (radius + 1)) - 1) + 1).tolist()
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the fingerprints (distinct, one bucket) that are within the radius of each other, by any steps.

    fps has a row of 64-bit words for each fingerprint. Breadth first: at most one link per fingerprint and no pairs
    held. A bucket over 4096 of one word is first cut by blocks of bits: two words within the radius agree on one of
    radius + 1 blocks, so no link between parts is lost.
    """
    if len(fps) <= 4096 or fps.shape[1] > 1:
        return search(fps, radius)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for block in np.array_split(np.arange(BITS), radius + 1):
        key = fps[:, 0] & np.uint64(sum(1 << int(i) for i in block))
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        for part in np.split(order, cuts):
            if len(part) == len(fps):
                return search(fps, radius)
            if len(part) > 1:
                x, y = search(fps[part], radius)
                a.append(part[x])
                b.append(part[y])
    return np.concatenate(a), np.concatenate(b)


def search(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the fingerprints of each group to its first one."""
    left, queue, root = np.arange(len(fps)), [], 0
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(left):
        if not queue:
            root = int(left[0])
            queue.append(root)
            left = left[1:]
        at = queue.pop()
        near = np.bitwise_count(fps[left] ^ fps[at]).sum(axis=1) <= radius
        if near.any():
            got = left[near]
            a.append(np.full(len(got), root))
            b.append(got)
            queue.extend(got.tolist())
            left = left[~near]
    return np.concatenate(a), np.concatenate(b)


def with_near(fps: np.ndarray, bounds: np.ndarray, radius: int, most: int = 256) -> np.ndarray:
    """The buckets (bounds of sorted rows) that hold two fingerprints within the radius; those over `most` unseen."""
    size = np.diff(bounds)
    owner = np.repeat(np.arange(len(size)), size)
    left = np.repeat(bounds[1:], size) - np.arange(len(owner))  # rows from here to the bucket's end
    hit = size > most
    at = np.flatnonzero((left > 1) & ~hit[owner])
    for k in range(1, most):
        at = at[(left[at] > k) & ~hit[owner[at]]]
        if not len(at):
            break
        hit[owner[at[np.bitwise_count(fps[at] ^ fps[at + k]).sum(axis=1) <= radius]]] = True
    return np.flatnonzero(hit)


def bucket_links(dealt: DataFrame, words: list[str], radius: int) -> DataFrame:
    """a, b: links of rep among the rows of dealt(bucket, rep, *words) that share a bucket, enough to join every group.
    A rep is in one bucket a table, so its links are as many as tables at most.

    Buckets are sorted and streamed, and in each every group is linked to its smallest rep, so a bucket of n
    fingerprints gives at most n - 1 rows and buckets that share a group mostly give the same ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in runs(batches, ["bucket"]):
            rep = rows.column("rep").to_numpy()
            fps = np.stack([rows.column(w).to_numpy() for w in words], axis=1).view(np.uint64)
            a, b = [rep[:0]], [rep[:0]]
            for i in with_near(fps, bounds, radius):
                at = bounds[i]
                x, y = forest(fps[at : bounds[i + 1]], radius)
                a.append(rep[at + x])
                b.append(rep[at + y])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    spread = dealt.select("bucket", "rep", *words).repartition(tasks(dealt.sparkSession), "bucket").sortWithinPartitions("bucket", "rep")
    found = spread.mapInArrow(run, "a long, b long").groupBy("b").agg(F.collect_set("a").alias("all"))
    # a rep has at most one link a table; all it is linked to are linked to the smallest of them instead
    least = F.array_min("all")
    every = found.select(least.alias("a"), F.explode(F.array_append(F.array_remove("all", least), F.col("b"))).alias("b"))
    return every.distinct()


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(reps: DataFrame, radius: int = 4) -> DataFrame:
    """a, b: representatives whose fingerprints differ in at most radius bits, enough of them to join every group.

    reps(fp, rep) holds distinct fingerprints. Each is dealt to one bucket per mask; a bucket is named by a hash of the
    mask's number and the masked bits, and buckets that share a name only make more comparisons.
    """
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(covering_masks(radius))]
    return bucket_links(reps.select("fp", "rep", F.explode(F.array(*keys)).alias("bucket")), ["fp"], radius)


def near_groups(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints that differ in at most radius bits are linked; component_id is the smallest doc_id reachable.
    Equal fingerprints are one node, so copies cost one row. Texts with fewer words than a shingle use the whole
    sequence; texts without words (null ones too) have fingerprint 0 and are linked like any other. Rows with a null
    doc_id get a null component unless a document with an id shares their fingerprint. doc_id must be an integer.
    """
    fps = materialise(fingerprints(docs, words))
    reps = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    held = reps.where("rep is not null").select("fp", F.col("rep").cast("long").alias("rep"))
    groups = components(links(held, radius))
    named = reps.join(groups, reps["rep"] == groups["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes, in order, of a text's shingles; a text of fewer words is one shingle.

    Words are cut at ASCII white space and compared with A-Z in lower case.
    """
    h = np.fromiter(map(_HASH.__getitem__, text.lower().split()), np.uint64)
    if not len(h):
        return h
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = (out ^ h[j : j + len(out)]) * _M1
        out ^= out >> np.uint64(29)
    return np.unique(out)


def sketch(found: np.ndarray) -> tuple[int, int]:
    """The SimHash of a set of shingles in two words of 64 bits, as signed numbers."""
    more = (found ^ (found >> np.uint64(32))) * _M2
    out = []
    for x in (found, more ^ (more >> np.uint64(29))):
        counts = np.zeros(BITS, np.int64)
        for at in range(0, len(x), 1 << 15):
            counts += np.unpackbits(x[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(counts * 2 > len(x), bitorder="little").view("<i8")[0]))
    return out[0], out[1]


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """docs with _set (a hash of 128 bits of the shingle set), _size (of the set) and its sketch in _one and _two."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in small(batches):
            sets = [shingles(x, words) for x in texts(batch)]
            two = np.array([sketch(x) for x in sets], np.int64).reshape(-1, 2)
            more = [
                pa.array([xxhash.xxh3_128_hexdigest(x.tobytes()) for x in sets], pa.string()),
                pa.array([len(x) for x in sets], pa.int64()),
                pa.array(two[:, 0]),
                pa.array(two[:, 1]),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *more], [*columns, "_set", "_size", "_one", "_two"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{types}, _set string, _size long, _one long, _two long")


def candidate_links(reps: DataFrame) -> DataFrame:
    """a, b: links of reps(rep, _one, _two) that share a bucket and differ in at most NEAR of their 128 bits.

    The words are cut into four blocks of 32 bits. By the pigeonhole, sketches that differ in at most 19 bits differ in
    at most 4 in some block, and the block's covering masks put them in one bucket; of the others the masks catch most.
    """
    masks = covering_masks(BLOCK_RADIUS, BLOCK)
    keys = []
    for word in ("_one", "_two"):
        for shift in range(0, BITS, BLOCK):
            keys += [F.xxhash64(F.lit(len(keys) + i), F.col(word).bitwiseAND(F.lit(signed(m << shift)))) for i, m in enumerate(masks)]
    return bucket_links(reps.select("rep", "_one", "_two", F.explode(F.array(*keys)).alias("bucket")), ["_one", "_two"], NEAR)


def similar(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the sets whose Jaccard index is at least `least`, by any steps, to the first of each group; sets
    are compared exactly.

    Breadth first, over an index from each shingle to the sets that hold it.
    """
    n, size = len(sets), np.array([len(x) for x in sets], np.int64)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        like = both >= least * (size.sum() - both)
        return (np.zeros(1, np.int64), np.ones(1, np.int64)) if like else (np.zeros(0, np.int64),) * 2
    every = np.concatenate(sets)
    _, shingle, held = np.unique(every, return_inverse=True, return_counts=True)
    holder = np.repeat(np.arange(n), size)[np.argsort(shingle, kind="stable")]
    first, starts = np.cumsum(held) - held, np.cumsum(size) - size
    left, queue = np.ones(n, bool), []
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        queue.append(root)
        while queue and left.any():
            at = queue.pop()
            mine = shingle[starts[at] : starts[at] + size[at]]
            n_held = held[mine]
            where = np.repeat(first[mine] - np.cumsum(n_held) + n_held, n_held) + np.arange(n_held.sum())
            both = np.bincount(holder[where], minlength=n)
            got = np.flatnonzero(left & (both > 0) & (both >= least * (size + size[at] - both)))
            left[got] = False
            a.append(np.full(len(got), root))
            b.append(got)
            queue += got.tolist()
        queue.clear()
    return np.concatenate(a), np.concatenate(b)


def verified_links(rows: DataFrame, words: int, least: float) -> DataFrame:
    """a, b: links of rows(rep, component, _size, text) of one component whose shingle sets have a Jaccard index of at
    least `least`, enough to join every group.

    A component that is larger than GROUP_BYTES is dealt to blocks, and each pair of blocks is a group of its own, so
    that no task holds more than two blocks.
    """
    size = rows.groupBy("component").agg((F.floor(F.sum("_size") * 8 / F.lit(GROUP_BYTES)) + 1).cast("int").alias("blocks"))
    many = size.where("blocks > 1")
    dealt = rows.join(F.broadcast(many), "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("rep", "component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got, bounds in runs(batches, ["component", "i", "j"]):
            rep, text = got.column("rep").to_numpy(), texts(got)
            a, b = [rep[:0]], [rep[:0]]
            for at, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if end - at > 1:
                    x, y = similar([shingles(t, words) for t in text[at:end]], least)
                    a.append(rep[at + x])
                    b.append(rep[at + y])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    spread = dealt.repartition(tasks(rows.sparkSession), "component", "i", "j").sortWithinPartitions("component", "i", "j")
    return spread.mapInArrow(run, "a long, b long")


@boxed
def drop_near(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one row of each group of near duplicates; all columns stay.

    Texts whose sets of five-word shingles have a Jaccard index of at least `least` are linked, and of the texts that
    links join the row with the smallest doc_id stays (null is last; rows of one doc_id by the hash of their text).
    Texts without words are alike among themselves only.

    Rows with equal sets are one class. Classes meet in the buckets of covering masks over blocks of their SimHash;
    those within NEAR bits form components of candidates, and inside each component the sets themselves decide. The
    similarity is exact, so no unlike texts are joined; of pairs at 0.8 the masks miss a few (README gives the measured
    share). A component of n copies costs n rows a table and no pairs.
    """
    rows = materialise(sketched(docs.withColumn("_row", F.monotonically_increasing_id()), words))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.md5(F.coalesce("text", F.lit(""))).alias("h"), F.col("_row"))
    light = rows.select("_row", "_set", "_size", "_one", "_two", order.alias("_order"))
    one = F.first(F.struct("_size", "_one", "_two")).alias("s")
    classes = materialise(light.groupBy("_set").agg(F.min("_order").alias("_order"), one).select(F.col("_order._row").alias("rep"), "_order", "s.*"))
    groups = components(candidate_links(classes.where("_size > 0")))
    held = classes.join(groups.withColumnRenamed("node", "rep"), "rep").select("rep", "component", "_size")
    held = held.join(rows.select(F.col("_row").alias("rep"), "text"), "rep")
    alike = components(verified_links(held, words, least))
    members = materialise(classes.join(alike.withColumnRenamed("node", "rep"), "rep").select("rep", "component", "_order"))
    stays = members.groupBy("component").agg(F.min("_order").alias("o")).select(F.col("o._row").alias("rep"))
    gone = members.select("rep").join(stays, "rep", "left_anti").select(F.col("rep").alias("_row"))
    copies = light.select("_row").join(classes.select(F.col("rep").alias("_row")), "_row", "left_anti")
    return rows.join(copies.unionByName(gone), "_row", "left_anti").select(*docs.columns)
