"""Packing tokenised documents into sequences: a configuration linear program, rounded."""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausemill.llm.common import id_text, materialise, small, texts

_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Token ids, as little-endian bytes, of a text in the vocabulary of a byte-level BPE ranks file.

    Pieces never cross a single space that follows a character other than white space, so a text is cut there and each
    part's ids are kept for its next occurrence. A special token's string in a text is the special token.
    """

    def __init__(self, path: str, pattern: str, special: dict[str, int], keep: int = 300_000):
        import base64
        import re

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = {k: array("I", [v]).tobytes() for k, v in special.items()}
        self.keep, self.kept = keep, {}
        self.odd = re.compile(r"\s ")
        self.joint = re.compile(r"(?<=\S) ")

    def _part(self, part: str) -> bytes:
        got = array("I", self.encoding.encode_ordinary(part)).tobytes()
        if len(self.kept) >= self.keep:
            self.kept.clear()
        if len(part) < 64:
            self.kept[part] = got
        return got

    def ids(self, text: str) -> bytes:
        for name, token in self.special.items():
            if name in text:
                return token.join(self.ids(x) for x in text.split(name))
        if not text:
            return b""
        parts = (self.joint if self.odd.search(text) else None) and self.joint.split(text) or text.split(" ")
        kept, out = self.kept, []
        for i, part in enumerate(parts):
            if i:
                part = " " + part
            got = kept.get(part)
            out.append(self._part(part) if got is None else got)
        return b"".join(out)


def encoder(name: str) -> Encoder:
    """The encoder of a public vocabulary, byte_bpe_50k: ids equal those of its tokenizers file."""
    if name not in _ENCODERS:
        import public_tokenizers

        _ENCODERS[name] = Encoder(public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})
    return _ENCODERS[name]


def pieces(docs: DataFrame, capacity: int = 1024, end: int = 2, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32: each document's ids and `end`, cut only if longer than capacity.

    A longer one is cut from its end into pieces of capacity; what is left over is the first piece. row numbers the
    input rows, so that repeated doc_ids stay apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(vocabulary), array("I", [end]).tobytes()
        for batch in small(batches):
            at, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(texts(batch)):
                ids = encode.ids(text.decode("utf-8", "replace")) + last
                n = len(ids) // 4
                a, k = 0, 0
                while a < n:
                    b = a + ((n - a - 1) % capacity + 1)
                    at.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                    a, k = b, k + 1
            taken = batch.select(["doc_id", "row"]).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [taken.column("doc_id"), taken.column("row"), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())],
                ["doc_id", "row", "piece", "start", "length", "ids_crc32"],
            )

    rows = id_text(docs).withColumn("row", F.monotonically_increasing_id())
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, row long, piece int, start long, length int, ids_crc32 long")


def price(values: np.ndarray, supply: np.ndarray, capacity: int) -> tuple[list[float], list[int]]:
    """The knapsack by dynamic programming: for each room the best value of lengths that fill it exactly (minus
    infinity if none do), and the length to take next.

    values[l] and supply[l] for lengths 1 to capacity; a length without supply is not used.
    """
    worth = np.where(supply > 0, values, -np.inf)[1:]
    best, pick = np.full(capacity + 1, -np.inf), np.zeros(capacity + 1, np.int64)
    best[0] = 0.0
    for room in range(1, capacity + 1):
        got = worth[:room] + best[room - 1 :: -1][:room]
        l = int(np.argmax(got))
        best[room], pick[room] = got[l], l + 1
    return best.tolist(), pick.tolist()


def filled(length: int, best: list[float], pick: list[int], capacity: int) -> Counter[int]:
    """The configuration of most value that holds an item of this length, as counts by length; full if any is."""
    out, room = Counter([length]), capacity - length
    while best[room] == -np.inf:
        room -= 1
    while room:
        out[pick[room]] += 1
        room -= pick[room]
    return out


def fractional(histogram: np.ndarray, capacity: int, batch: int = 16, step: float = 0.5, slope: float = 0.3, eta: float = 0.5, tail: float = 0.002) -> dict[tuple[tuple[int, int], ...], float]:
    """Configurations (counts by length) and how often each is used, in fractions; together they cover at most
    histogram[l] items of each length l and all but `tail` of the tokens.

    Multiplicative weights for the covering program: the weight of a length falls by a factor with each share of its
    items covered, so those that lag behind are worth more; longer ones start with more a token, as short ones fit
    later too. Each round prices all rooms by one knapsack; the `batch` longest lengths left take the configuration of
    most value that holds them, in a dose of `step` of what its scarcest length allows, in whole uses where it can.
    No length is covered beyond its items, so what the full configurations cost is what they hold.
    """
    size, left = np.arange(capacity + 1), histogram.astype(float)
    total, found = float((left * size).sum()), {}
    while (left * size).sum() > tail * total:
        lag = np.divide(left, histogram, out=np.zeros(capacity + 1), where=histogram > 0)
        weight = (size / capacity) ** (1 + slope) * np.exp(eta * lag)
        best, pick = price(weight, left, capacity)
        gain = False
        for l in np.flatnonzero(left)[::-1][:batch].tolist():
            if not left[l]:
                continue
            need = filled(l, best, pick, capacity)
            most = min(left[x] / k for x, k in need.items())
            if most < 1e-9:
                continue
            dose = most if most <= 1 else max(1.0, float(int(step * most)))
            c = tuple(sorted(need.items()))
            found[c], gain = found.get(c, 0.0) + dose, True
            for x, k in need.items():
                left[x] = max(0.0, left[x] - dose * k) if left[x] - dose * k > 1e-9 else 0.0
        if not gain:
            break
    return found


def solve(histogram: np.ndarray, capacity: int, reserve: float = 0.06) -> list[tuple[int, np.ndarray]]:
    """(times, counts by length): configurations that hold exactly histogram[l] items of each length l.

    The program covers all but a reserve of each length (rounded, so rare lengths have none). Its solution is rounded
    down, fractions being carried from one configuration to the next, and full configurations are used so often. The
    reserve and what rounding leaves have about the mix of the whole and are packed longest first, each sequence
    filled best-fit, in counts by length.
    """
    left = histogram.astype(np.int64).copy()
    out: list[tuple[int, dict[int, int]]] = []
    carry = 0.0
    for c, dose in sorted(fractional(histogram - np.floor(histogram * reserve + 0.5).astype(np.int64), capacity).items(), reverse=True):
        if sum(x * k for x, k in c) < capacity:
            continue
        carry += dose
        times = min(int(carry + 1e-9), *(int(left[x]) // k for x, k in c))
        if times > 0:
            out.append((times, dict(c)))
            carry -= times
            for x, k in c:
                left[x] -= times * k
        carry = min(carry, 1.0)
    while left.any():
        c, room = Counter(), capacity
        while room:
            l = next((x for x in np.flatnonzero(left[: room + 1])[::-1].tolist() if left[x] > c[x]), 0)
            if not l:
                break
            n = min(int(left[l]) - c[l], room // l)
            c[l] += n
            room -= n * l
        c = {x: k for x, k in c.items() if k}
        times = min(int(left[x]) // k for x, k in c.items())
        for x, k in c.items():
            left[x] -= times * k
        out.append((times, c))
    return [(times, np.bincount(list(c), list(c.values()), capacity + 1).astype(np.int64)) for times, c in out]


def pack(docs: DataFrame, capacity: int = 1024, end: int = 2, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Spark tokenises, counts the lengths (a histogram of capacity numbers, all that the driver sees), and numbers the
    pieces of each length without gaps from counts by lane, so that a length that a third of all pieces share is no
    single task. The driver turns the histogram into configurations; a configuration used `times` times is `times`
    sequences in a row. A piece's number within its length falls into one configuration's range and gives its
    sequence and its place there. The table of ranges has a row for each of at most `capacity` lengths; the number of
    ranges grows with the logarithm of the counts, so it is sent to the tasks.

    A null text is empty: its piece is the end token alone. Repeated doc_ids are packed each. An empty table gives no
    rows.
    """
    spark = docs.sparkSession
    cut = materialise(pieces(docs, capacity, end, vocabulary).withColumn("lane", F.pmod(F.xxhash64("row", "piece"), F.lit(512)).cast("int")))
    lanes = materialise(cut.groupBy("length", "lane").agg(F.count(F.lit(1)).alias("held")))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in lanes.groupBy("length").agg(F.sum("held").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    ranges, used, base = [], np.zeros(capacity + 1, np.int64), 0
    for times, c in solve(histogram, capacity):
        place = 0
        for l in np.flatnonzero(c)[::-1].tolist():
            n = int(c[l])
            ranges.append((l, int(used[l]), int(used[l] + n * times), n, base, place))
            used[l] += n * times
            place += n * l
        base += times
    table = spark.createDataFrame(ranges or [(0, 0, 0, 1, 0, 0)], "length int, first long, past long, each long, base long, place long")
    by = Window.partitionBy("length").orderBy("lane")
    lanes = lanes.select("length", "lane", (F.sum("held").over(by) - F.col("held")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "lane").orderBy("row", "piece")) - 1
    numbered = cut.withColumn("inside", inside).join(lanes, ["length", "lane"]).withColumn("number", F.col("inside") + F.col("before"))
    slots = table.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("past", "first", "each", "base", "place"))).alias("slots"))
    held = numbered.join(F.broadcast(slots), "length").withColumn("slot", F.filter("slots", lambda s: F.col("number") < s["past"])[0])
    nth = F.col("number") - F.col("slot.first")
    return held.select(
        "doc_id",
        "piece",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        (F.col("slot.base") + F.floor(nth / F.col("slot.each"))).alias("sequence_id"),
        (F.col("slot.place") + (nth % F.col("slot.each")) * F.col("length")).alias("offset"),
    )
