"""A counterfactually regularised toxicity classifier."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.llm.common import id_text, materialise, small, texts

#: Groups that a neutral sentence may mention, in English, German, French and Spanish; terms of a set are swapped for
#: one another.
IDENTITY_SETS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "muslims", "christians", "jews"),
    ("black", "white", "asian", "african", "european", "arab", "latino", "latina"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "trans", "queer"),
    ("immigrant", "immigrants", "refugee", "refugees", "foreigner", "foreigners", "migrant", "migrants"),
    ("disabled", "blind", "deaf", "autistic", "old", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen", "frau", "mann"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer", "araber"),
    ("schwule", "lesben", "heterosexuelle", "bisexuelle", "transsexuelle"),
    ("einwanderer", "flüchtlinge", "ausländer", "migranten", "asylbewerber"),
    ("femmes", "hommes", "filles", "garçons", "femme", "homme"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "africains", "européens", "arabes"),
    ("homosexuels", "lesbiennes", "hétérosexuels", "bisexuels", "transgenres"),
    ("immigrés", "réfugiés", "étrangers", "migrants"),
    ("mujeres", "hombres", "chicas", "chicos", "mujer", "hombre"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos", "árabes"),
    ("homosexuales", "lesbianas", "heterosexuales", "bisexuales", "transexuales"),
    ("inmigrantes", "refugiados", "extranjeros", "migrantes"),
)
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
#: Stems are word beginnings of so many bytes.
STEMS = (4, 5, 6, 7, 8)
_SWAP: dict[bytes, list[bytes]] = {}
for _set in IDENTITY_SETS:
    for _t in _set:
        _SWAP.setdefault(_t.encode(), []).extend(u.encode() for u in _set if u != _t)
#: Features that a swap takes out of a text and that it puts in, as numbers in the vocabulary.
Swap = tuple[tuple[int, ...], tuple[int, ...]]


def words(text: bytes) -> set[bytes]:
    """Distinct words of letters and digits, A-Z in lower case, and their stems (marked by a star)."""
    found = set(_WORD.findall(text.lower()))
    out = set(found)
    for k in STEMS:
        out.update(x + b"*" for x in {w[:k] for w in found if len(w) > k})
    return out


def features_of(word: bytes) -> list[bytes]:
    """A word and its stems."""
    return [word, *(word[:k] + b"*" for k in STEMS if len(word) > k)]


def swaps(text: bytes, at: dict[bytes, int]) -> list[Swap]:
    """For every identity term of a text and every term it may be swapped for: how the text's features change.

    Stems are made anew, and a feature stays that other words of the text have too.
    """
    found = set(_WORD.findall(text.lower()))
    terms = found & _SWAP.keys()
    if not terms:
        return []
    held = Counter(at[f] for w in found for f in features_of(w) if f in at)
    out = []
    for t in sorted(terms):
        mine = [at[f] for f in features_of(t) if f in at]
        for u in _SWAP[t]:
            theirs = [] if u in found else [at[f] for f in features_of(u) if f in at]
            gone = tuple(f for f in mine if held[f] == 1 and f not in theirs)
            come = tuple(f for f in theirs if f not in held)
            if gone or come:
                out.append((gone, come))
    return out


class Classifier:
    """Logistic regression on the presence of chosen words.

    The loss adds penalty * (change of the logit)^2 for every identity term of a training text and every term it may
    be swapped for, so that a text and its counterfactuals score alike, and ridge * weights^2 draws all towards none.
    """

    def __init__(self, vocabulary: list[bytes], weights: np.ndarray, bias: float):
        given = dict(zip(vocabulary, weights.tolist()))
        self.weight, self.bias = {w: x for w, x in given.items() if not w.endswith(b"*")}, float(bias)
        self.stems = {k: {w[:-1]: x for w, x in given.items() if w.endswith(b"*") and len(w) == k + 1} for k in STEMS}
        self.stems = {k: x for k, x in self.stems.items() if x}

    def score(self, text: bytes) -> float:
        found = set(_WORD.findall(text.lower()))
        parts = [self.bias, *map(self.weight.__getitem__, found & self.weight.keys())]
        for k, stems in self.stems.items():
            parts += map(stems.__getitem__, {w[:k] for w in found if len(w) > k} & stems.keys())
        z = math.fsum(parts)
        return 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))


def choose(bags: list[set[bytes]], y: np.ndarray, least: int, z: float) -> list[bytes]:
    """Words in at least `least` texts whose share among toxic texts differs by z standard errors or more."""
    held, toxic = Counter(), Counter()
    for bag, label in zip(bags, y.tolist()):
        held.update(bag)
        if label:
            toxic.update(bag)
    n, t = len(y), max(1, int(y.sum()))
    rate, out = t / max(1, n), []
    for w, c in held.items():
        if c >= least and abs(toxic[w] - c * rate) >= z * np.sqrt(c * rate * (1 - rate) + 0.25):
            out.append(w)
    return sorted(out)


def fit(sample: list[bytes], labels: list[int], least: int = 4, z: float = 6.0, **how: float) -> Classifier:
    """Choose words and train on texts with labels 0 and 1, all in memory."""
    y = np.array(labels, float)
    bags = [words(x) for x in sample]
    vocabulary = sorted({*choose(bags, y, least, z), *(t for t in _SWAP if any(t in b for b in bags))}) if len(y) else []
    at = {w: i for i, w in enumerate(vocabulary)}
    changes = Counter(c for x in sample for c in swaps(x, at))
    return train(vocabulary, [sorted(at[w] for w in b & at.keys()) for b in bags], y, changes, **how)


def train(vocabulary: list[bytes], bags: list[list[int]], y: np.ndarray, changes: Counter[Swap], penalty: float = 20.0, ridge: float = 3e-4, steps: int = 400, even: float = 0.7) -> Classifier:
    """Train on the chosen words that each text holds; even: how far the two labels are weighed alike, 0 to 1.

    changes counts the swaps of the training texts. Each term of a set is also swapped once for each other on its own,
    so that terms that no training text holds are tied too, through their stems. Without labels of both kinds the
    score is their share (0.25 if none).
    """
    if not len(y) or y.min() == y.max():
        p = 0.25 if not len(y) else min(0.99, max(0.01, float(y.mean())))
        return Classifier([], np.zeros(0), np.log(p / (1 - p)))
    rows = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    cols = np.array([i for b in bags for i in b], np.int64)
    at = {w: i for i, w in enumerate(vocabulary)}
    every = changes + Counter(c for t in _SWAP for c in swaps(t, at))
    gone, come = ([len(c[k]) for c in every] for k in (0, 1))
    pair = np.concatenate([np.repeat(np.arange(len(every)), gone), np.repeat(np.arange(len(every)), come)]).astype(np.int64)
    feature = np.array([f for k in (0, 1) for c in every for f in c[k]], np.int64)
    sign = np.concatenate([-np.ones(sum(gone)), np.ones(sum(come))])
    share = np.array(list(every.values()), float) / len(y)
    w, bias = np.zeros(len(vocabulary)), float(np.log(y.mean() / (1 - y.mean())))
    balance = np.where(y > 0, (0.5 / y.mean()) ** even, (0.5 / (1 - y.mean())) ** even)
    momentum, slope = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):  # Adam
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(rows, w[cols], len(y)), -30, 30)))
        error = (p - y) * balance / len(y)
        g = np.bincount(cols, error[rows], len(w)) + 2 * ridge * w
        if len(share):
            change = np.bincount(pair, sign * w[feature], len(share))
            g += np.bincount(feature, sign * (2 * penalty * share * change)[pair], len(w))
        g = np.append(g, error.sum())
        momentum, slope = 0.9 * momentum + 0.1 * g, 0.999 * slope + 0.001 * g * g
        rate = 0.1 * (1 - 0.9 * step / steps)
        move = rate * (momentum / (1 - 0.9**step)) / (np.sqrt(slope / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return Classifier(vocabulary, w, bias)


def choose_even(vocabulary: list[bytes], bags: list[list[int]], y: np.ndarray, changes: Counter[Swap], penalty: float, folds: int = 3, steps: int = 120, choices: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> float:
    """How far labels are weighed alike: of the choices the one whose out-of-fold predictions of the training rows have the
    largest F1 (the smaller of ties). Folds are rows by number; no other row is read."""
    right = []
    for even in choices:
        score = np.zeros(len(y))
        for fold in range(folds):
            mine = np.arange(len(y)) % folds != fold
            got = train(vocabulary, [b for b, m in zip(bags, mine) if m], y[mine], changes, penalty, steps=steps, even=even)
            weight = np.array([got.stems.get(len(v) - 1, {}).get(v[:-1], 0.0) if v.endswith(b"*") else got.weight.get(v, 0.0) for v in vocabulary])
            for i in np.flatnonzero(~mine):
                score[i] = got.bias + weight[bags[i]].sum()
        hits = int(((score >= 0) & (y == 1)).sum())
        right.append(2 * hits / max(1, int((score >= 0).sum() + y.sum())))
    return choices[int(np.argmax(right))]


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text is divisible by 5; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, max_sample: int = 8000, penalty: float = 20.0, least: int = 4, z: float = 6.0) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    The classifier learns from labelled documents that are not held out, at most max_sample of them in the order of a
    hash of doc_id. Tasks count the sample's words and stems by label, and Spark keeps those that tell the labels
    apart; the driver sees which of these each sample text holds and how swaps of identity terms change them, never a
    text, fits the weights and sends them to the tasks. How far the labels are weighed alike is chosen by folds of the sample. Only the text is an input of the score. Null and empty texts get the score of a text without any chosen
    word. Several labels for a document are as many training rows; null labels are left out. Without labels the score
    is 0.25.
    """
    spark = docs.sparkSession
    rows = id_text(docs).withColumn("held_out", is_held_out(F.col("doc_id")))
    marks = labels.where("toxic is not null").select("doc_id", "toxic").where(~is_held_out(F.col("doc_id")))
    picked = marks.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id", "toxic").limit(max_sample)
    sample = materialise(picked.join(rows.select("doc_id", "text"), "doc_id").select("order", F.col("toxic").cast("int").alias("toxic"), "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1 << 20):
            held, toxic = Counter(), Counter()
            for x, y in zip(texts(batch), batch.column("toxic").to_pylist()):
                bag = words(x)
                held.update(bag)
                if y == 1:
                    toxic.update(bag)
            every = list(held)
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.binary()), pa.array([held[w] for w in every], pa.int64()), pa.array([toxic[w] for w in every], pa.int64())], ["feature", "held", "toxic"])

    n, t = sample.agg(F.count(F.lit(1)), F.count_if(F.col("toxic") == 1)).first()
    rate = t / max(1, n)
    counted = sample.select("toxic", "text").mapInArrow(count, "feature binary, held long, toxic long").groupBy("feature").agg(F.sum("held").alias("held"), F.sum("toxic").alias("toxic"))
    far = F.abs(F.col("toxic") - F.col("held") * rate) >= z * F.sqrt(F.col("held") * rate * (1 - rate) + 0.25)
    terms = F.col("feature").isin(*[F.lit(bytearray(t)) for t in _SWAP])
    vocabulary = sorted(bytes(r["feature"]) for r in counted.where((F.col("held") >= least) & far | terms).select("feature").collect())
    at = {w: i for i, w in enumerate(vocabulary)}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1 << 20):
            got = [sorted(at[w] for w in words(x) & at.keys()) for x in texts(batch)]
            changes = [[{"gone": list(a), "come": list(b)} for a, b in swaps(x, at)] for x in texts(batch)]
            change = pa.list_(pa.struct([("gone", pa.list_(pa.int32())), ("come", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("order"), batch.column("toxic"), pa.array(got, pa.list_(pa.int32())), pa.array(changes, change)], ["order", "toxic", "bag", "changes"]
            )

    told = sample.mapInArrow(bags, "order long, toxic int, bag array<int>, changes array<struct<gone: array<int>, come: array<int>>>").collect()
    given = sorted((r["order"], r["toxic"], list(r["bag"])) for r in told)
    changes = Counter((tuple(c["gone"]), tuple(c["come"])) for r in told for c in r["changes"])
    y, chosen = np.array([y for _, y, _ in given], float), [b for _, _, b in given]
    even = choose_even(vocabulary, chosen, y, changes, penalty) if len(y) and y.min() < y.max() else 0.0
    model = spark.sparkContext.broadcast(train(vocabulary, chosen, y, changes, penalty, even=even))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            got = [model.value.score(x) for x in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(got, pa.float64()), pa.array([int(p >= 0.5) for p in got], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")
