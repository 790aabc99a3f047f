"""Reading text files, JSON lines and fetched bodies; what cannot be read is told as rows of violations."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausemill.sources.staging import staged

#: Largest file that is read, and the extensions that are. Fixed values.
MAX_BYTES = 25 * 1024 * 1024
EXTENSIONS = ("txt",)
_HIGH = {bytes([b]): bytes([b]).decode("cp1250", "replace") for b in range(128, 256)}
_LATIN = "".join(b.decode("latin-1") for b in _HIGH)
_CENTRAL = "".join(_HIGH.values())


def decoded(content: Column) -> Column:
    """UTF-8 without its byte order mark, else code page 1250; its undefined bytes become U+FFFD."""
    utf8 = F.regexp_replace(content.cast("string"), "^﻿", "")
    return F.when(F.is_valid_utf8(content.cast("string")), utf8).otherwise(F.translate(F.decode(content, "ISO-8859-1"), _LATIN, _CENTRAL))


def read_text(spark: SparkSession, paths: str | list[str], max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """documents(path, text) and violations(rule, key, detail) of text files.

    limit_exceeded: a file above max_bytes, whose content is not read. unsupported_input: another extension.
    corrupt_input: bytes that neither encoding has. empty_input: white space alone, or no bytes at all: readers do not hand
    such files on, so they are those that the listing has and the reader has not.
    """
    files = spark.read.format("binaryFile").load(paths)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    refused = F.when(F.col("length") > max_bytes, "limit_exceeded").when(~kind.isin(*EXTENSIONS), "unsupported_input")
    outside = files.select(refused.alias("rule"), F.col("path").alias("key"), F.col("length").cast("string").alias("detail")).where("rule is not null")
    texts = files.where((F.col("length") <= max_bytes) & kind.isin(*EXTENSIONS)).select("path", F.is_valid_utf8(F.col("content").cast("string")).alias("utf8"), decoded(F.col("content")).alias("text"))
    rule = F.when(~F.col("utf8") & F.col("text").contains("�"), "corrupt_input").when(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")) == "", "empty_input")
    judged = texts.withColumn("rule", rule)
    inside = judged.where("rule is not null").select("rule", F.col("path").alias("key"), F.lit(None).cast("string").alias("detail"))
    return judged.where("rule is null").select("path", "text"), outside.unionByName(inside).unionByName(unread_files(files))


def unread_files(files: DataFrame) -> DataFrame:
    """rule, key, detail of the files that a binaryFile table's listing names and its rows lack: those of no bytes.

    The listing is the one that Spark itself makes on the driver, of any store it reads; contents are not read for this.
    """
    same = lambda c: F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")
    raw = lambda c: F.regexp_replace(c, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")
    listed = files.sparkSession.createDataFrame([(x,) for x in files.inputFiles()], "listed string").select(same(F.col("listed")).alias("key"))
    held = files.select(raw(F.col("path")).alias("key"))
    return listed.join(held, "key", "left_anti").select(F.lit("empty_input").alias("rule"), "key", F.lit("0").alias("detail"))


def read_json_lines(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """rows(path, line, value) of JSON objects and violations(rule, key, detail) with the line number; blank lines are
    skipped. A file is one row until it is split, so files are bounded by what a task holds; write many small ones."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n", -1)).alias("pos", "value"))
    lines = files.where(F.trim("value") != "").select("path", (F.col("pos") + 1).alias("line"), "value")
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    judged = lines.withColumn("ok", is_object)
    return judged.where("ok").drop("ok"), judged.where("not ok").select(F.lit("not_an_object").alias("rule"), F.col("path").alias("key"), F.col("line").cast("string").alias("detail"))


def canonical_json(columns: list[str]) -> Column:
    """Columns as JSON with sorted keys, no spaces and characters as they are; nulls are kept."""
    return F.to_json(F.struct(*[F.col(c).alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def valid_responses(responses: DataFrame) -> DataFrame:
    """key, seq, body: the first valid body of each key, a hash of its address and media type.

    responses(url, media_type, seq, body). JSON must parse to an object or list, HTML hold 10 characters, PDF begin with
    its mark; null bodies and other types are not valid.
    """
    shape = F.schema_of_variant(F.try_parse_json("body"))
    ok = (
        F.when(F.col("media_type") == "application/json", shape.startswith("OBJECT") | shape.startswith("ARRAY"))
        .when(F.col("media_type") == "text/html", F.length("body") >= 10)
        .when(F.col("media_type") == "application/pdf", F.col("body").startswith("%PDF"))
    )
    key = F.sha2(F.concat_ws("|", "url", "media_type"), 256)
    nth = F.row_number().over(Window.partitionBy("key").orderBy("seq"))
    return responses.where(F.coalesce(ok, F.lit(False))).select(key.alias("key"), "seq", "body").withColumn("nth", nth).where("nth = 1").drop("nth")


def hash_prose(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with these columns replaced by their SHA-256; a null stays null."""
    return df.withColumns({c: F.sha2(F.col(c), 256) for c in columns})


def read_runs(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Recorded runs from JSON files, one object a file: schema's columns, artifact_id and arm.

    Where the object does not name its artifact and arm, the path does: .../<artifact>/<arm>.json.
    """
    rows = spark.read.schema(schema).json(paths, multiLine=True).select("*", F.col("_metadata.file_path").alias("file_path"))
    part = lambda i: F.nullif(F.regexp_extract("file_path", r"([^/]+)/([^/]+)\.json$", i), F.lit(""))
    named = {c: F.coalesce(F.col(c), part(i)) if c in rows.columns else part(i) for i, c in ((1, "artifact_id"), (2, "arm"))}
    return rows.withColumns(named)


#: The tables of run metadata. Text of findings is never stored.
RUN_TABLES = {
    "runs": "run_id string, document_id string, arm string, status string, failure string, model string, tokens long, created_at timestamp",
    "attempts": "run_id string, seq int, success boolean, model string, tokens long, elapsed_ms long",
    "findings": "run_id string, seq int, finding_id string, unit_id string, code string, start_offset int, end_offset int, page int",
}


def _hadoop(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path, as Hadoop has them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _commits(spark: SparkSession, path: str) -> list:
    """batch, nth and tables of the committed batches of a store: a small record a batch."""
    fs, at = _hadoop(spark, f"{path}/_commits")
    return spark.read.schema("batch string, nth long, tables array<string>").json(f"{path}/_commits").collect() if fs.exists(at) else []


def _rows(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table's rows of committed batches with the batch's nth. Only their folders are listed: what a failed write left
    behind, or one at work is writing, is in none."""
    done = [c for c in _commits(spark, path) if name in c["tables"]]
    if not done:
        return spark.createDataFrame([], f"{RUN_TABLES[name]}, nth long")
    rows = spark.read.schema(f"{RUN_TABLES[name]}, batch string").option("basePath", f"{path}/{name}").parquet(*[f"{path}/{name}/batch={c['batch']}" for c in done])
    order = spark.createDataFrame([(c["batch"], c["nth"]) for c in done], "batch string, nth long")
    return rows.join(F.broadcast(order), "batch").drop("batch")


def write_run_tables(tables: dict[str, DataFrame], path: str, mode: str = "append", batch: str | None = None) -> DataFrame:
    """Write rows of the run tables as one batch, children of unknown runs left out; rule, key of those rows.

    Each table gets a folder of the batch, and the batch counts once its commit record is there, which is made last, by
    renaming, so a reader sees all of a batch or nothing. A batch that failed on the way is written again under its name,
    in place of what it left; one that was committed is not written again. A run that a later batch writes replaces the
    earlier one, children and all (see read_run_table). Without a name a batch gets one that no other has. A child's run
    must be among the runs written with it or committed before. mode "overwrite" drops all that was committed, once the new batch is.
    """
    spark = next(iter(tables.values())).sparkSession
    batch = batch or uuid.uuid4().hex
    done = {c["batch"]: c["nth"] for c in _commits(spark, path)}
    runs = tables["runs"].select("run_id")
    if mode == "append":
        runs = runs.unionByName(_rows(spark, path, "runs").select("run_id"))
    runs, orphans = runs.distinct(), spark.createDataFrame([], "rule string, key string")
    for name, schema in RUN_TABLES.items():
        if name not in tables:
            continue
        rows = tables[name].to(spark.createDataFrame([], schema).schema)
        if name != "runs":
            orphans = orphans.unionByName(rows.join(runs, "run_id", "left_anti").select(F.lit(f"unknown_run_of_{name}").alias("rule"), F.col("run_id").alias("key")))
            rows = rows.join(runs, "run_id", "left_semi")
        if batch not in done:
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
    orphans = staged(orphans)
    if batch not in done:
        fs, made = _hadoop(spark, f"{path}/_staging/{batch}.json")
        out = fs.create(made, True)
        out.write(bytearray(json.dumps({"batch": batch, "nth": max(done.values(), default=0) + 1, "tables": [x for x in RUN_TABLES if x in tables]}).encode()))
        out.close()
        fs.mkdirs(_hadoop(spark, f"{path}/_commits")[1])
        if not fs.rename(made, _hadoop(spark, f"{path}/_commits/{batch}.json")[1]):
            raise OSError(f"batch {batch} could not be committed")
        if mode == "overwrite":
            for old in done:
                fs.delete(_hadoop(spark, f"{path}/_commits/{old}.json")[1], False)
    return orphans


def read_run_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A run table in the order it was made: runs by time, children by run and place.

    Of each run the batch that wrote it last counts, and of children those of that batch or of later ones that added to it.
    """
    rows, runs = _rows(spark, path, name), _rows(spark, path, "runs").groupBy("run_id").agg(F.max("nth").alias("last"))
    rows = rows.join(runs, "run_id").where("nth >= last").drop("nth", "last")
    return rows.orderBy("created_at", "run_id") if name == "runs" else rows.orderBy("run_id", "seq")


def append_json(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Append one canonical JSON record a row to the JSON lines under path."""
    rows.select(canonical_json(columns).alias("value")).write.mode("append").text(path)
