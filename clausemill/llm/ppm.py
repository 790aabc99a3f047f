"""Language-model scores by prediction by partial matching over bytes, with a unigram base score."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.llm.common import id_text, materialise, small, texts

END, START, WIDTH = 256, 257, 9
#: Bytes and the end: what may come next.
SYMBOLS = 257
_EMPTY, _MIX = np.uint64((1 << 64) - 1), np.uint64(0x9E3779B97F4A7C15)


def symbols(batch: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts in lower case as symbols, each led in by `order` starts and closed by an end; where each text begins."""
    lead = np.full(order, START, np.uint16)
    parts = []
    for x in batch:
        parts += [lead, np.frombuffer(x.lower(), np.uint8).astype(np.uint16), np.array([END], np.uint16)]
    sizes = np.array([len(x) for x in batch], np.int64) + order + 1
    return np.concatenate(parts) if parts else lead[:0], np.concatenate(([0], np.cumsum(sizes)))


def grams_of(batch: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Every symbol of the texts with the `order` symbols before it, packed in 9 bits each; which text each is of."""
    seq, starts = symbols(batch, order)
    if not len(seq):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(seq) - order
    key = np.zeros(n, np.uint64)
    for j in range(order + 1):
        key = (key << np.uint64(WIDTH)) | seq[j : j + n]
    text = seq[order:] != START  # windows that end in the next text's lead-in predict nothing
    return key[text], np.repeat(np.arange(len(batch)), np.diff(starts))[order:][text]


def gram_counts(rows: DataFrame, order: int) -> DataFrame:
    """gram, n, m: the grams of rows(held_out, text), how often in rows not held out, and how often at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keys, inverse = np.unique(np.concatenate([k for k, _, _ in held]), return_inverse=True)
            return keys, *(np.bincount(inverse, np.concatenate([h[i] for h in held])).astype(np.int64) for i in (1, 2))

        def out(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(columns[0]), 1 << 17):
                keys, n, m = (x[at : at + (1 << 17)] for x in columns)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(m)], ["gram", "n", "m"])

        for batch in small(batches, 2 << 20):
            every, outside = texts(batch), batch.column("held_out").to_pylist()
            for apart in (False, True):
                keys, m = np.unique(grams_of([x for x, o in zip(every, outside) if o == apart], order)[0], return_counts=True)
                held.append((keys, np.zeros(len(m), np.int64) if apart else m, m))
            if sum(len(k) for k, _, _ in held) > 1_500_000:
                held = [merged()]
                if len(held[0][0]) > 1_000_000:
                    yield from out(*held.pop())
        if held:
            yield from out(*merged())

    counted = rows.select("held_out", "text").mapInArrow(run, "gram long, n long, m long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def predicted(counted: DataFrame, order: int) -> DataFrame:
    """gram, m, logp: counted(gram, n, m) with log10 P(last symbol | the `order` symbols before it), from the counts n.

    Method C: in a context with T occurrences of U symbols, a symbol seen n times has n / (T + U), and an escape to the
    context without its first symbol has U / (T + U). What a context has seen its suffix has seen too, so exclusion
    takes off the suffix's T the counts there of the symbols seen in the context, and off its U their number. Tables
    of depths 0 to order are joined from the shortest up: a row of depth d meets the one of its suffix with the same
    symbol. Contexts never seen pass on to their suffix. All contexts that occur are kept, so the tables grow with the
    corpus; a suffix has at most 258 rows that meet it and a context 257 symbols, so no key is hot.
    """
    levels = {order: counted.select(F.col("gram").alias("key"), "n")}
    for d in range(order - 1, -1, -1):
        low = F.col("key").bitwiseAND(F.lit((1 << WIDTH * (d + 1)) - 1))
        levels[d] = materialise(levels[d + 1].groupBy(low.alias("key")).agg(F.sum("n").alias("n")))
    done = None
    for d in range(order + 1):
        rows = levels[d].withColumn("context", F.shiftright("key", WIDTH))
        same = Window.partitionBy("context")
        rows = rows.withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << WIDTH * d) - 1)))
        if done is None:
            rows = rows.select("*", *(F.lit(0).alias(c) for c in ("sn", "st", "su")), F.lit(1.0 / SYMBOLS).alias("sp"), F.lit(1.0).alias("sq"))
        else:
            rows = rows.join(done.select(F.col("key").alias("suffix"), *(F.col(c).alias(f"s{c}") for c in "ntupq")), "suffix")
        rows = rows.withColumn("t", F.sum("n").over(same)).withColumn("u", F.sum((F.col("n") > 0).cast("long")).over(same))
        excluded = F.sum(F.when(F.col("n") > 0, F.col("sn")).otherwise(0)).over(same)
        if done is None:
            q = F.lit(1.0) / F.greatest(F.lit(1), F.lit(SYMBOLS) - F.col("u"))
        else:
            rows = rows.withColumn("rest", F.col("st") - excluded).withColumn("new", F.col("su") - F.col("u"))
            both = F.col("rest") + F.col("new")
            q = F.when(both == 0, F.col("sq")).when(F.col("sn") > 0, F.col("sn") / both).otherwise(F.col("new") / both * F.col("sq"))
        whole = F.col("t") + F.col("u")
        rows = rows.withColumn("q", q)
        p = F.when(F.col("n") > 0, F.col("n") / whole).when(F.col("t") > 0, F.col("u") / whole * F.col("q")).otherwise(F.col("sp"))
        done = rows.select("key", "n", "t", "u", p.alias("p"), "q")
    return counted.select("gram", "m").join(done.select(F.col("key").alias("gram"), F.log10("p").alias("logp")), "gram")


class Table:
    """Values of 64-bit keys by open addressing, looked up for whole arrays of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, _EMPTY), np.zeros(1 << bits)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == _EMPTY]
            self.keys[at[free]] = keys[free]  # of keys for one place the last one gets it
            placed = self.keys[at[left]] == keys[left]
            self.values[at[left[placed]]] = values[left[placed]]
            left = left[~placed]
            at[left] = (at[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of keys (0 for those not held) and whether each is held."""
        at = self._home(keys)
        found, out = self.keys[at] == keys, self.values[at]
        left = np.flatnonzero(~found)
        out[left] = 0
        at = at[left]
        while len(left):
            going = self.keys[at] != _EMPTY
            left, at = left[going], (at[going] + 1) & self.mask
            hit = self.keys[at] == keys[left]
            found[left[hit]] = True
            out[left[hit]] = self.values[at[hit]]
            left, at = left[~hit], at[~hit]
        return out, found


def word_counts(rows: DataFrame) -> DataFrame:
    """word, c, m: words of rows(held_out, text) in lower case (A-Z), how often in rows not held out, and how often at
    all; the end of a text is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: Counter[bytes] = Counter()
        outside: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words = list(every)
            for at in range(0, len(words), 1 << 16):
                part = words[at : at + (1 << 16)]
                m = np.array([every[w] for w in part], np.int64)
                c = m - np.array([outside[w] for w in part], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()).cast(pa.string()), pa.array(c), pa.array(m)], ["word", "c", "m"])
            every.clear()
            outside.clear()

        for batch in small(batches):
            for x, apart in zip(texts(batch), batch.column("held_out").to_pylist()):
                words = [*x.lower().split(), b""]
                every.update(words)
                if apart:
                    outside.update(words)
            if len(every) > 1_000_000:
                yield from out()
        yield from out()

    counted = rows.select("held_out", "text").mapInArrow(run, "word string, c long, m long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("m").alias("m"))


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves 1 on division by 5; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def lm_scores(docs: DataFrame, order: int = 5, hot_grams: float = 3e-7, hot_words: float = 1e-6) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows not held out. score is the log10 probability of the text in lower case (A-Z) and its end,
    byte by byte, by PPM over contexts of up to `order` bytes: method C escapes, symbol exclusion, every context kept.
    Both models are tables in Spark, made of all rows and as large as the corpus makes them. A text's score is the sum
    over its grams: those that make up hot_grams of all positions or more, so at most 1 / hot_grams of them, are sent
    to the tasks with their values, and the others meet their values in a join by gram; so too for words and
    base_score with hot_words. The two shares decide only how a value travels.

    A null text is empty: one token, the end. Without training rows all words are unknown and each byte is equally
    likely. Repeated rows are scored each, and equal rows get equal scores. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = id_text(docs).withColumn("held_out", is_held_out(F.col("doc_id"))).withColumn("row", F.monotonically_increasing_id())
    counts = materialise(word_counts(rows))
    n, v, m = (x or 0 for x in counts.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.sum("m")).first())
    below = n + 0.5 * (v + 1)
    counts = counts.select("word", "c", (F.col("m") >= hot_words * m).alias("hot"))
    got = counts.where("hot").toArrow()
    hot_counts = spark.sparkContext.broadcast(dict(zip(got.column("word").cast(pa.binary()).to_pylist(), got.column("c").to_pylist())))

    model = materialise(predicted(materialise(gram_counts(rows, order)), order))
    positions = model.agg(F.sum("m")).first()[0] or 0
    model = model.select("gram", "logp", (F.col("m") >= hot_grams * positions).alias("hot"))
    got = model.where("hot").select("gram", "logp").toArrow()
    table = spark.sparkContext.broadcast(Table(got.column("gram").to_numpy().view(np.uint64), got.column("logp").to_numpy()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = {w: (c > 0, np.log10((c + 0.5) / below)) for w, c in hot_counts.value.items()}
        for batch in small(batches, 1 << 20):
            every = texts(batch)
            tokens, known, base, words, times = [], [], [], [], []
            for x in every:
                split = x.lower().split()
                split.append(b"")
                found = [logs[w] for w in split if w in logs]
                rest = Counter(w for w in split if w not in logs) if len(found) < len(split) else {}
                tokens.append(len(split))
                known.append(sum(k for k, _ in found))
                base.append(sum(b for _, b in found))
                words.append([w.decode("utf-8", "replace") for w in rest])
                times.append(list(rest.values()))
            keys, owner = grams_of(every, order)
            value, found = table.value.find(keys)
            at = np.flatnonzero(~found)
            cuts = np.searchsorted(owner[at], np.arange(len(every) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("row", "doc_id", "held_out")),
                    pa.array(tokens, pa.int64()),
                    pa.array(known, pa.int64()),
                    pa.array(base, pa.float64()),
                    pa.array(np.bincount(owner, value, len(every))),
                    pa.array(words, pa.list_(pa.string())),
                    pa.array(times, pa.list_(pa.int64())),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys[at].view(np.int64))),
                ],
                ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "words", "times", "grams"],
            )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    scored = materialise(
        rows.mapInArrow(
            score,
            f"row long, doc_id {id_type}, held_out boolean, n_tokens long, known long, base double, score double, "
            "words array<string>, times array<bigint>, grams array<bigint>",
        )
    )
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    rare = rare.join(counts.where("not hot").select("word", "c"), "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((F.col("c") + 0.5) / F.lit(float(below)))).alias("more_base"),
    )
    deep = scored.select("row", F.explode("grams").alias("gram")).join(model.where("not hot").select("gram", "logp"), "gram")
    deep = deep.groupBy("row").agg(F.sum("logp").alias("more_score"))
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias
    return (
        scored.join(rare, "row", "left")
        .join(deep, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            plus("known", "more_known")("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            plus("base", "more_base")("base_score"),
            plus("score", "more_score")("score"),
        )
    )
