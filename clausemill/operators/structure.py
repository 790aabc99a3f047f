"""Document structure: lines, markers, units, sentences and windows, with character offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.sources.staging import staged

#: Levels in order of preference: name, pattern at a line start, kind of path. Fixed values.
LEVELS = (
    ("paragraph", r"(?iu)^(?:§|[S5$8])[\s\p{Z}]*(\d+)", "numeric"),
    ("article", r"(?iu)^Art\.[\s\p{Z}]*(\d+)", "numeric"),
    ("outline", r"(?iu)^(\d+(?:\.\d+)*)\.?(?=[\s\p{Z}])", "outline"),
    ("section", r"(?iu)^ust\.[\s\p{Z}]*(\d+)", "numeric"),
    ("point", r"(?iu)^pkt\.[\s\p{Z}]*(\d+)", "numeric"),
    ("letter", r"(?iu)^lit\.[\s\p{Z}]*([a-ząćęłńóśźż])", "letter"),
)
_SENTENCE_START = "[A-ZĄĆĘŁŃÓŚŹŻ]"


def running(lengths: Column, block: int = 256) -> Column:
    """Running sums of an array of lengths, in blocks, so that the work is about n * block and not n * n."""
    add = lambda xs, start: F.aggregate(xs, F.array(start), lambda got, x: F.concat(got, F.array(F.element_at(got, -1) + x)))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(lengths) / block) - 1).cast("int")), lambda i: F.slice(lengths, i * block + 1, F.lit(block)))
    starts = add(F.transform(blocks, lambda xs: F.aggregate(xs, F.lit(0), lambda got, x: got + x)), F.lit(0))
    inside = F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), lambda xs, start: F.slice(add(xs, start), F.lit(2), F.size(xs)))
    return F.flatten(inside)


def pieces(documents: DataFrame, parts: Column, keep: tuple[str, ...] = (), following: bool = False) -> DataFrame:
    """doc_id, keep, pos, piece, start, end: parts of a text that make it up, with running offsets; and, if asked for,
    following: of a part that is not blank, the digits or else the first character that the next such part begins with.

    Offsets are summed up inside the row, so no text is shuffled. The next part that is not blank is found by the number of
    those so far, however many blank ones lie between.
    """
    rows = documents.select("doc_id", *keep, parts.alias("parts"))
    rows = rows.withColumn("ends", running(F.transform("parts", F.length)))
    zipped = ["parts", "ends"]
    if following:
        full = lambda x: x.rlike(r"[^\s\p{Z}]")
        begins = F.transform(F.filter("parts", full), lambda x: F.regexp_extract(x, r"^[\s\p{Z}]*(\d+|[^\s\p{Z}])", 1))
        rows = rows.withColumns({"begins": begins, "so_far": running(F.transform("parts", lambda x: F.when(full(x), 1).otherwise(0)))})
        after = F.zip_with("parts", "so_far", lambda x, n: F.when(full(x), F.coalesce(F.get("begins", n), F.lit(""))).otherwise(""))
        zipped.append(after.alias("after"))
    got = rows.select("doc_id", *keep, F.posexplode(F.arrays_zip(*zipped)).alias("pos", "x"))
    end, piece = F.col("x.ends"), F.col("x.parts")
    more = [F.col("x.after").alias("following")] if following else []
    return got.select("doc_id", *keep, "pos", piece.alias("piece"), (end - F.length(piece)).cast("long").alias("start"), end.cast("long").alias("end"), *more)


def line_anchors(documents: DataFrame) -> DataFrame:
    """doc_id, line (from 1), start_offset, end_offset: one anchor per line, terminator included."""
    got = pieces(documents, F.split("text", "(?<=\n)", -1)).where("piece <> ''")
    return got.select("doc_id", (F.col("pos") + 1).cast("long").alias("line"), F.col("start").alias("start_offset"), F.col("end").alias("end_offset"))


def content_groups(documents: DataFrame) -> DataFrame:
    """content_hash, n_docs, first_doc of each content."""
    return documents.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


def markers(documents: DataFrame) -> DataFrame:
    """doc_id, length, level, rank, offset, path of the numbering markers at line starts, for every level.

    A pattern may reach over the line's end, so each line is read with what the next that is not blank begins with. A path
    holds decimal numbers as texts without leading zeros, of any length; a letter is its code.
    """
    sized = documents.select("doc_id", "text", F.length("text").alias("length"))
    lines = pieces(sized, F.split("text", "(?<=\n)", -1), ("length",), following=True)
    lines = lines.select("doc_id", "length", F.col("start").alias("offset"), F.concat("piece", "following").alias("view"))
    found = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(name).alias("level"), F.lit(kind).alias("kind"), F.regexp_extract("view", pattern, 1).alias("raw")) for i, (name, pattern, kind) in enumerate(LEVELS)])
    rows = lines.select("doc_id", "length", "offset", F.explode(found).alias("m")).where("m.raw <> ''")
    path = F.when(F.col("m.kind") == "letter", F.array(F.ascii(F.lower("m.raw")).cast("string"))).otherwise(F.transform(F.split("m.raw", "\\."), lambda x: F.regexp_replace(x, r"^0+(?=\d)", "")))
    return rows.select("doc_id", "length", F.col("m.level").alias("level"), F.col("m.rank").alias("rank"), "offset", path.alias("path"))


def next_number(number: Column) -> Column:
    """The number after a decimal number without leading zeros, both as texts of any length: nines at its end become zeros
    and the digit before them goes up."""
    nines = F.regexp_extract(number, "9*$", 0)
    head = F.substring(number, F.lit(1), F.length(number) - F.length(nines))
    up = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.translate(F.right(head, F.lit(1)), "012345678", "123456789"))
    return F.concat(F.when(head == "", "1").otherwise(up), F.repeat(F.lit("0"), F.length(nines)))


def is_successor(previous: Column, following: Column) -> Column:
    """Whether one path may follow another: a restart at 1, a first child, or an increment with descent to ones."""
    previous, following = previous.cast("array<string>"), following.cast("array<string>")

    def step(k: Column) -> Column:
        head = F.concat(F.slice(previous, F.lit(1), k - 1), F.array(next_number(F.get(previous, k - 1))))
        rest = F.slice(following, k + 1, F.greatest(F.size(following), F.lit(1)))
        return (F.slice(following, F.lit(1), k) == head) & F.forall(rest, lambda x: x == "1")

    one = F.array(F.lit("1"))
    return (following == one) | (following == F.concat(previous, one)) | F.exists(F.sequence(F.lit(1), F.size(previous)), step)


def level_stats(marked: DataFrame) -> DataFrame:
    """doc_id, level, rank, n_markers, monotonicity, coverage, tail of each level of a document."""
    order = Window.partitionBy("doc_id", "level").orderBy("offset")
    before = F.lag("path").over(order)
    rows = marked.withColumn("follows", F.when(before.isNotNull(), is_successor(before, F.col("path")).cast("int")))
    return rows.groupBy("doc_id", "level", "rank", "length").agg(
        F.count(F.lit(1)).alias("n_markers"),
        F.coalesce(F.avg("follows"), F.lit(1.0)).alias("monotonicity"),
        ((F.col("length") - F.min("offset")) / F.col("length")).alias("coverage"),
        ((F.col("length") - F.max("offset")) / F.col("length")).alias("tail"),
    )


def _enough(least: int = 3, monotonicity: float = 0.8, coverage: float = 0.6, tail: float = 0.5) -> Column:
    return (F.col("n_markers") >= least) & (F.col("monotonicity") >= monotonicity) & (F.col("coverage") >= coverage) & (F.col("tail") <= tail)


def choose_level(stats: DataFrame, **limits: float) -> DataFrame:
    """doc_id, level: the first level in order that is structural enough; documents without one are left out."""
    return stats.where(_enough(**limits)).groupBy("doc_id").agg(F.min_by("level", "rank").alias("level"))


def structural_units(documents: DataFrame) -> DataFrame:
    """doc_id, pos, start_offset, end_offset: units cut at the markers of the chosen level; they tile the text.

    Markers are dealt by doc_id once; the statistics of the levels, the choice and the cuts are windows on that.
    """
    marked = markers(documents).repartition("doc_id")
    level, doc = Window.partitionBy("doc_id", "level"), Window.partitionBy("doc_id")
    before = F.lag("path").over(level.orderBy("offset"))
    rows = marked.withColumn("follows", F.when(before.isNotNull(), is_successor(before, F.col("path")).cast("int")))
    rows = rows.withColumns(
        {
            "n_markers": F.count(F.lit(1)).over(level),
            "monotonicity": F.coalesce(F.avg("follows").over(level), F.lit(1.0)),
            "coverage": (F.col("length") - F.min("offset").over(level)) / F.col("length"),
            "tail": (F.col("length") - F.max("offset").over(level)) / F.col("length"),
        }
    ).where(_enough())
    rows = rows.withColumn("best", F.min("rank").over(doc)).where("rank = best")
    pos = F.row_number().over(doc.orderBy("offset")) - 1
    end = F.coalesce(F.lead("offset").over(doc.orderBy("offset")), F.col("length"))
    return rows.select("doc_id", pos.alias("pos"), F.when(pos == 0, 0).otherwise(F.col("offset")).alias("start_offset"), end.alias("end_offset"))


def sentences(documents: DataFrame) -> DataFrame:
    """doc_id, pos, start_offset, end_offset: a sentence ends at . ! or ? before white space and a capital, or at the
    end; the white space between belongs to none."""
    text = F.regexp_replace("text", r"(?<=[.!?])\n\z", "")
    rows = pieces(documents, F.split(text, rf"(?<=[.!?])(?=\s+{_SENTENCE_START})", -1))
    skip = F.when(F.col("pos") == 0, 0).otherwise(F.length("piece") - F.length(F.regexp_replace("piece", r"^\s+", "")))
    rows = rows.where(F.trim(F.regexp_replace("piece", r"\s+", "")) != "")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    return rows.select("doc_id", place.alias("pos"), (F.col("start") + skip).alias("start_offset"), F.col("end").alias("end_offset"))


def window_units(spans: DataFrame, size: int = 3, overlap: int = 1) -> DataFrame:
    """doc_id, pos, start_offset, end_offset: windows of `size` sentences that overlap; the last holds the last sentence."""
    step = size - overlap
    if step <= 0:
        raise ValueError("invalid_window: overlap must be smaller than size")
    order, whole = Window.partitionBy("doc_id").orderBy("pos"), Window.partitionBy("doc_id")
    ends = [F.lead("end_offset", k).over(order) for k in range(size - 1, 0, -1)]
    rows = spans.select("doc_id", "pos", "start_offset", F.coalesce(*ends, F.col("end_offset")).alias("end_offset"), F.count(F.lit(1)).over(whole).alias("n"))
    last = F.when(F.col("n") <= size, 0).otherwise(F.ceil((F.col("n") - size) / step) * step)
    return rows.where((F.col("pos") % step == 0) & (F.col("pos") <= last)).select("doc_id", F.floor(F.col("pos") / step).cast("int").alias("pos"), "start_offset", "end_offset")


def segment(documents: DataFrame) -> DataFrame:
    """doc_id, mode, pos, start_offset, end_offset: structural units where a level passes, else windows.

    Structural units are written to the shared folder, so they are made once."""
    held = documents.where(F.trim(F.regexp_replace("text", r"\s+", "")) != "")
    structural = staged(structural_units(held))
    rest = held.join(structural.select("doc_id").distinct(), "doc_id", "left_anti")
    return structural.withColumn("mode", F.lit("structural")).unionByName(window_units(sentences(rest)).withColumn("mode", F.lit("window")))


def segment_violations(documents: DataFrame, units: DataFrame) -> DataFrame:
    """rule, key: documents of white space alone, and others without a unit."""
    blank = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "")) == ""
    some = units.select("doc_id").distinct().withColumn("some", F.lit(True))
    rows = documents.select("doc_id", blank.alias("blank")).join(some, "doc_id", "left")
    rule = F.when(F.col("blank"), "empty_document").when(F.col("some").isNull(), "no_units")
    return rows.select(rule.alias("rule"), F.col("doc_id").cast("string").alias("key")).where("rule is not null")


def is_fallback(units: DataFrame) -> DataFrame:
    """doc_id, fallback: whether any unit begins before the one before it has ended."""
    before = F.lag("end_offset").over(Window.partitionBy("doc_id").orderBy("pos"))
    rows = units.select("doc_id", F.coalesce(before > F.col("start_offset"), F.lit(False)).alias("over"))
    return rows.groupBy("doc_id").agg(F.bool_or("over").alias("fallback"))


def input_hash(documents: DataFrame, units: DataFrame) -> DataFrame:
    """doc_id, input_hash over the content hash and the spans of the units in order."""
    spans = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(":", "start_offset", "end_offset").alias("span")))).alias("s"))
    joined = documents.select("doc_id", F.sha2("text", 256).alias("h")).join(spans, "doc_id")
    return joined.select("doc_id", F.sha2(F.concat_ws("|", "h", F.lit("None"), F.array_join(F.col("s.span"), ",")), 256).alias("input_hash"))


def derived_clauses(documents: DataFrame) -> DataFrame:
    """doc_id, text: documents with their lines numbered as paragraphs, some referring to others."""
    i = lambda n: (n + 1).cast("string")
    line = lambda x, n: F.concat(F.lit("§ "), i(n), F.lit(". "), x, F.when((n + 1) % 3 == 0, F.concat(F.lit(" zgodnie z § "), n.cast("string"))).otherwise(""), F.when((n + 1) % 5 == 0, F.concat(F.lit(" oraz załącznik nr "), i(n))).otherwise(""))
    return documents.select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("text"))


def doc_profile(documents: DataFrame, units: DataFrame) -> DataFrame:
    """doc_id, n_chars, n_words, n_units, fallback of each document."""
    n = units.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_units"))
    joined = documents.join(n, "doc_id", "left").join(is_fallback(units), "doc_id", "left")
    return joined.select("doc_id", F.length("text").alias("n_chars"), F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"))).alias("n_words"), F.coalesce("n_units", F.lit(0)).alias("n_units"), F.coalesce("fallback", F.lit(False)).alias("fallback"))
