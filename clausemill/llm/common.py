"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A word: a run of anything but ASCII white space. bytes.split() cuts at the same characters.
WORD = "[^\\x20\\x09-\\x0D]+"


def scratch(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Where it is unset, a local session gets a temporary folder; any other
    is an error, as its machines would not see each other's files."""
    if at := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return at
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set")
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
    return jsc.getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, and lost executors cost only what they ran."""
    at = f"{scratch(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._written_at = at
    return out


def release(df: DataFrame) -> None:
    """Delete the table of materialise, which nothing that is still to run may read."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever other columns there are; a null text is empty."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def boxed(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that keeps the columns of its docs, given doc_id, text, lang and source as they are and all others in one column.

    So no other name can clash with those the stage makes inside, whatever it is (_row, a dotted one, one with backticks);
    columns come back under their names and in their order. Names that differ in case alone are one name to Spark.
    """

    @wraps(stage)
    def run(docs: DataFrame, *args: object, **named: object) -> DataFrame:
        own = [c for c in docs.columns if c in ("doc_id", "text", "lang", "source")]
        others = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in own}
        if not others:
            return stage(docs, *args, **named)
        quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
        out = stage(docs.select(*own, F.struct(*[quoted(c).alias(x) for c, x in others.items()]).alias("boxed")), *args, **named)
        return out.select(*[F.col("boxed")[others[c]].alias(c) if c in others else F.col(c) for c in docs.columns])

    return run


def texts(batch: pa.RecordBatch | pa.Table, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def small(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about limit bytes, so that working arrays stay small."""
    for batch in batches:
        n = max(1, -(-batch.nbytes // limit))
        step = max(1, -(-batch.num_rows // n))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by keys (integers, not null) as tables of whole groups, each with the bounds of its groups.

    A group may span batches; only the group at the end of a batch is held over.
    """
    held: list[pa.RecordBatch] = []

    def changes(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
        found = np.zeros(max(0, batch.num_rows - 1), bool)
        for k in keys:
            found |= np.diff(batch.column(k).to_numpy()) != 0
        return np.flatnonzero(found) + 1

    def whole(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(parts).combine_chunks()
        return table, np.concatenate(([0], changes(table), [table.num_rows])).astype(np.int64)

    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = changes(batch)
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield whole(held)
            held = []
        if len(cuts):
            yield whole([*held, batch.slice(0, int(cuts[-1]))])
            held = [batch.slice(int(cuts[-1]))]
        else:
            held.append(batch)
    if held:
        yield whole(held)


class WordHash(dict):
    """64-bit hash of a word, kept until there are too many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
