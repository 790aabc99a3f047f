"""Text of acts from characters and lines: raised indexes, article headings and the articles between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

#: Article headings at a line's start, numbers that may be one or two, and annex headings. Fixed values.
HEADING = r"(?U)^[ \t]*Art\.\s*(\d+[a-z]*(?:\(\d+\)|\[\d+\]|\^\d+|[⁰¹²³⁴⁵⁶⁷⁸⁹]+|\d+)?)(?:\.|\s*$)"
AMBIGUOUS = r"(?U)^[ \t]*Art\.\s*\d+\s+\d+(?:\.|\s*$)"
ANNEX = r"(?U)^\s*Załącznik(?:i)?\b"
OPENS, CLOSES = "„", "”"
#: Characters below the first share of a page's size are small, those from the second on are of its size. Fixed values.
SMALL, FULL = 0.85, 0.9
_DIGIT = r"^[\p{Nd}⁰¹²³⁴-⁹₀-₉]$"
_BLANK = r"(?U)^[\s\x1c-\x1f]*$"


# What a character is: a digit (0 apart), blank, a small letter, of which a, r and t may introduce an article, A or a stop;
# _LONG is added where it is not one code point.
_OTHER, _ONE, _ZERO, _SPACE, _LETTER, _SMALL_A, _R, _T, _LARGE_A, _STOP, _LONG = *range(10), 16


def _kind(text: Column) -> Column:
    letter = F.when(text == "a", _SMALL_A).when(text == "r", _R).when(text == "t", _T).otherwise(_LETTER)
    kind = F.when(text.rlike("^[a-z]$"), letter).when(text.rlike(_DIGIT), F.when(text == "0", _ZERO).otherwise(_ONE)).when(text.rlike(_BLANK), _SPACE).when(text == "A", _LARGE_A).when(text == ".", _STOP).otherwise(_OTHER)
    return (kind + F.when(F.length(text) == 1, 0).otherwise(_LONG)).cast("byte")


def _whole_pages(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Pages that are whole, with their first rows; rows of a page follow each other, and a page that is not ended waits."""
    held: list[pa.RecordBatch] = []
    for batch in (b for b in batches if b.num_rows):
        rows = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch] if held else [batch])
        new = np.zeros(rows.num_rows, bool)
        for key in rows.columns[:n_keys]:
            here, there = key.slice(1), key.slice(0, rows.num_rows - 1)
            unlike = pc.or_(pc.fill_null(pc.not_equal(here, there), False), pc.not_equal(pc.is_null(here), pc.is_null(there)))
            new[1:] |= unlike.to_numpy()
        first = np.flatnonzero(new[1:] if held else new)
        if not first.size:
            held.append(batch)
            continue
        whole = pa.Table.from_batches([*held, batch.slice(0, first[-1])])
        if whole.num_rows:
            yield whole, np.concatenate([[0], first[:-1] + (whole.num_rows - first[-1])]).astype(np.int64)
        held = [batch.slice(first[-1])]
    if held:
        yield pa.Table.from_batches(held), np.zeros(1, np.int64)


def _mark(kind: np.ndarray, tenths: np.ndarray, sized: np.ndarray, y0: np.ndarray, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows of the groups of characters that become one, and whether each is a raised run; pages are the first rows of pages.

    Rows that look back do so by row numbers, of which -1, a row of nothing at the end, stands for none.
    """
    n, at = len(kind), np.arange(len(kind))
    page = np.repeat(np.arange(len(pages)), np.diff(np.append(pages, n)))
    since = pages[page]
    single, kind = kind < _LONG, kind % _LONG
    none = lambda x, v=False: np.append(x, v)
    last = lambda some: (lambda j: np.where(j >= since, j, -1))(np.maximum.accumulate(np.where(some, at, -1)))  # noqa: E731  up to a row
    left = np.where(at > since, at - 1, -1)

    # the page's size
    counted = np.flatnonzero(sized)
    body = np.full(len(pages), np.nan)
    if counted.size:
        sizes, code = np.unique(tenths[counted], return_inverse=True)
        alike, first, often = np.unique(page[counted] * len(sizes) + code, return_index=True, return_counts=True)
        of = alike // len(sizes)
        best = np.lexsort((first, -often, of))
        best = best[np.append(True, np.diff(of[best]) > 0)]
        body[of[best]] = sizes[alike[best] % len(sizes)]
    body = body[page]

    digit, letter = (kind == _ONE) | (kind == _ZERO), (kind >= _LETTER) & (kind <= _T)
    small = digit & (tenths < SMALL * body)

    # what stands before a character, blanks left out
    before = none(none(last(kind != _SPACE), -1)[left], -1)
    is_ = lambda *some: none(np.isin(kind, some))
    stop = is_(_STOP) & is_(_T)[before] & is_(_R)[before[before]] & is_(_LARGE_A, _SMALL_A)[before[before[before]]]

    # whether a character ends an article's number: what its first digit comes after holds for all digits and letters that touch
    after_digit, after_letter = none(digit)[left], none(letter)[left]
    introduced = none(none(stop[before])[last(digit & ~after_digit)])
    suffixed = none(after_digit & introduced[left])[last(letter & ~after_letter)]
    numbers = none((digit & introduced[:-1]) | (letter & suffixed))

    before = before[:-1]
    held = none(digit)[before] | (none(single)[before] & numbers[left])
    starts = small & held & (none(tenths, np.nan)[before] >= FULL * body) & (y0 > none(y0, np.nan)[before]) & (kind != _ZERO)

    # runs: islands of small digits whose first one starts
    head = last(~(small & none(small)[left]))
    first = np.flatnonzero(~(small & starts[head]) | (head == at))
    return first, np.logical_or.reduceat(starts, first)


def _marked(chars: DataFrame, keys: tuple[str, ...], whole: bool) -> DataFrame:
    """The rows of mark_superscripts, or the texts of superscript_texts, of chars that come page by page and in order."""
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(float("inf")))
    text = F.coalesce("text", F.lit(""))
    kept = [] if whole else ["seq", *[F.col(c).cast("double").alias(c) for c in ("size", "x0", "x1", "y0")]]
    rows = chars.select(*keys, text.alias("text"), _kind(text).alias("kind"), number("tenths").alias("tenths"), number("y0").alias("high"), *kept)
    names, n_keys = rows.columns, len(keys)
    out = StructType([*rows.schema.fields[:n_keys], StructField("n_marked", LongType()), StructField("text", StringType())]) if whole else StructType([*rows.schema.fields[:n_keys], *chars.select("seq").schema.fields, StructField("text", StringType()), *[StructField(c, DoubleType()) for c in ("size", "x0", "x1", "y0")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, pages in _whole_pages(batches, n_keys):
            text, kind, tenths, y0 = (c.combine_chunks() for c in table.columns[n_keys : n_keys + 4])
            sized = pc.and_(pc.is_valid(tenths), pc.not_equal(text, "")).to_numpy(zero_copy_only=False)
            floats = lambda x: pc.fill_null(x, np.nan).to_numpy(zero_copy_only=False)
            first, raised = _mark(kind.to_numpy(), floats(tenths), sized, floats(y0), pages)
            end = np.append(first[1:], table.num_rows)
            opens, closes = np.zeros(table.num_rows, bool), np.zeros(table.num_rows, bool)
            opens[first[raised]] = closes[end[raised] - 1] = True
            parts = pc.binary_join_element_wise(pc.if_else(opens, "[", ""), text, pc.if_else(closes, "]", ""), "")
            cuts = pages if whole else first
            joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.append(cuts, table.num_rows), pa.int64()), parts), "")
            found = [table.column(i).take(pa.array(cuts)) for i in range(n_keys)]
            if whole:
                found += [pa.array(np.add.reduceat(opens.astype(np.int64), cuts)), joined]
            else:
                of = lambda c, i: table.column(n_keys + 4 + c).take(pa.array(i))
                found += [of(0, first), joined, of(1, first), of(2, first), of(3, end - 1), of(4, first)]
            yield from pa.table(found, names=out.names).combine_chunks().to_batches(10_000)

    assert len(names) == n_keys + (4 if whole else 9)
    return rows.mapInArrow(run, out)


def mark_superscripts(chars: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> tuple[DataFrame, DataFrame]:
    """chars with raised runs of digits as one character [n], and rule, key, detail of pages without a size.

    chars(keys, seq, text, size, x0, x1, y0): the characters of a page in order of seq. A page's size is the commonest of
    its sizes, rounded to tenths (the first of those that tie). A small digit begins a run if it stands higher than the
    character before it (blanks left out), and that one is of the page's size and is a digit, or ends the number of an
    article: Art., digits and small letters, of which the last touches the run. Small digits that touch it go on with the run; one that begins with 0
    stays as it is. The row of a run has the place of its first character and the end of its last.

    Pages are one shuffle and one sort; tasks then read page after page, and hold one with as many more as a batch has. Null
    texts are empty, and a null size neither counts nor is small. Repeated seq go by x0. Other columns are left out.
    """
    rows = chars.withColumn("tenths", F.round(F.col("size").cast("double"), 1)).select(*keys, "seq", "text", "size", "x0", "x1", "y0", "tenths")
    marked = _marked(rows.repartition(*keys).sortWithinPartitions(*keys, "seq", F.col("x0").cast("double")), keys, whole=False)
    sized = F.bool_or((F.coalesce("text", F.lit("")) != "") & F.col("tenths").isNotNull())
    sizeless = rows.groupBy(*keys).agg(sized.alias("sized")).where("not sized")
    return marked, sizeless.select(F.lit("malformed_structure").alias("rule"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("key"), F.lit("no sized characters").alias("detail"))


def superscript_texts(chars: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """keys, n_marked, text: pages' characters with raised runs of digits as [n], joined, and the number of runs.

    chars(keys, text, size, y0) as in mark_superscripts, but unfolded from rows of pages: a page's characters come
    together and in order, and pages that follow each other differ in their keys. So nothing is shuffled or sorted.
    """
    return _marked(chars.select(*keys, "text", "y0", F.round(F.col("size").cast("double"), 1).alias("tenths")), keys, whole=True)


def scan_headings(lines: DataFrame, longest: int = 200, heading: str = HEADING, ambiguous: str = AMBIGUOUS, opens: str = OPENS, closes: str = CLOSES) -> tuple[DataFrame, DataFrame]:
    """doc_id, line, start_offset, number of headings outside of quotations; and rule, key, detail of what breaks.

    lines(doc_id, line, text): a document's lines in order, without terminators. Depth is quotations opened less closed at
    a line's end. ambiguous_article_number: a number that may be one or two, where a heading may stand.
    unbalanced_quotes, with surplus, open for n or unclosed as detail and the line: more are closed than are open (depth
    goes on from 0, so headings that follow are found); more than `longest` lines in a row end inside a quotation (the
    rest of that run counts as outside); a quotation is open at the end.

    A running sum that never falls below 0 is the sum less its least value so far, so no line depends on the decision of
    another, and the rest is islands of open lines. Only counts and numbers are shuffled, not lines. A null text is empty.
    """
    line = F.regexp_replace(F.coalesce("text", F.lit("")), "\r?\n$", "")
    marks = lambda m: F.length(line) - F.length(F.replace(line, F.lit(m), F.lit("")))
    rows = lines.select("doc_id", "line", F.length(line).alias("length"), (marks(opens) / len(opens) - marks(closes) / len(closes)).cast("long").alias("change"), F.regexp_extract(line, heading, 1).alias("number"), F.trim(F.when(line.rlike(ambiguous), line)).alias("unclear"))
    order = Window.partitionBy("doc_id").orderBy("line")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"sum": F.sum("change").over(upto), "start_offset": F.coalesce(F.sum(F.col("length") + 1).over(before), F.lit(0))})
    rows = rows.withColumns({"floor": F.least(F.lit(0), F.min("sum").over(upto)), "floor_before": F.least(F.lit(0), F.coalesce(F.min("sum").over(before), F.lit(0)))})
    rows = rows.withColumns({"depth": F.col("sum") - F.col("floor"), "surplus": F.col("sum") < F.col("floor_before"), "n": F.row_number().over(order)})
    shut = F.coalesce(F.max(F.when(F.col("depth") == 0, F.col("n"))).over(upto), F.lit(0))
    rows = rows.withColumn("open_for", F.col("n") - shut)
    opened = F.coalesce(F.lag("open_for").over(order), F.lit(0))
    rows = rows.withColumns({"outside": (opened == 0) | (opened > longest), "last": F.lead("line").over(order).isNull()})
    found = rows.where("outside and number <> '' and unclear is null").select("doc_id", "line", "start_offset", "number")
    at = lambda what: F.concat(what, F.lit(" at line "), F.col("line").cast("string"))
    told = F.array(
        F.when(F.col("outside") & F.col("unclear").isNotNull(), F.struct(F.lit("ambiguous_article_number").alias("rule"), at(F.col("unclear")).alias("detail"))),
        F.when(F.col("surplus"), F.struct(F.lit("unbalanced_quotes").alias("rule"), at(F.lit("surplus")).alias("detail"))),
        F.when(F.col("open_for") == longest + 1, F.struct(F.lit("unbalanced_quotes").alias("rule"), at(F.concat(F.lit("open for "), F.col("open_for").cast("string"))).alias("detail"))),
        F.when(F.col("last") & (F.col("depth") > 0), F.struct(F.lit("unbalanced_quotes").alias("rule"), at(F.lit("unclosed")).alias("detail"))),
    )
    broken = rows.select("doc_id", F.explode(F.filter(told, lambda x: x.isNotNull())).alias("v"))
    return found, broken.select(F.col("v.rule").alias("rule"), F.col("doc_id").cast("string").alias("key"), F.col("v.detail").alias("detail"))


def article_texts(found: DataFrame, lines: DataFrame, annex: str = ANNEX) -> tuple[DataFrame, DataFrame]:
    """doc_id, number, line, last_line, text of the articles that found(doc_id, line, number) begin; and rule, key, detail
    of those without a text and of documents without an article.

    An article goes to the line before the next heading; the last one stops before the first annex heading after it began,
    or at the document's end. Blank ends are cut off. Lines before the first heading belong to none. A heading without a
    line of its own is an empty article.
    """
    heads = found.select("doc_id", "line", "number")
    rows = lines.select("doc_id", "line", F.regexp_replace(F.coalesce("text", F.lit("")), "\r?\n$", "").alias("text"), F.lit(None).cast("string").alias("number")).unionByName(heads.select("doc_id", "line", F.lit(None).cast("string").alias("text"), "number"))
    order, doc = Window.partitionBy("doc_id").orderBy("line", F.col("number").isNull()), Window.partitionBy("doc_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"head": F.last(F.when(F.col("number").isNotNull(), F.struct("line", "number")), ignorenulls=True).over(upto), "final": F.max(F.when(F.col("number").isNotNull(), F.col("line"))).over(doc)})
    annexed = F.min(F.when(F.col("text").rlike(annex) & (F.col("line") >= F.col("final")), F.col("line"))).over(doc)
    rows = rows.withColumn("annexed", annexed).where(F.col("head").isNotNull() & (F.col("annexed").isNull() | (F.col("line") < F.col("annexed"))))
    held = F.when(F.col("text").isNotNull(), F.struct("line", "text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(held)), lambda x: x["text"]), "\n")
    whole = rows.groupBy("doc_id", "head").agg(F.max("line").alias("last_line"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "").alias("text"))
    whole = whole.select("doc_id", F.col("head.number").alias("number"), F.col("head.line").alias("line"), "last_line", "text")
    empty = whole.where("text = ''").select(F.lit("malformed_structure").alias("rule"), F.col("doc_id").cast("string").alias("key"), F.concat(F.lit("empty article text for "), F.col("number")).alias("detail"))
    none = lines.select("doc_id").distinct().join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(F.lit("malformed_structure").alias("rule"), F.col("doc_id").cast("string").alias("key"), F.lit("no articles").alias("detail"))
    return whole.where("text <> ''"), empty.unionByName(none)


def superscript_tags(text: Column) -> Column:
    """<sup>n</sup> as raised digits: texts are cut before each tag and digits are translated in what it opens."""
    parts = F.split(text, r"(?i)(?=<sup>[0-9]+</sup>)", -1)
    raise_first = lambda x: F.concat(F.translate(F.regexp_extract(x, r"(?i)^<sup>([0-9]+)</sup>", 1), "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹"), F.regexp_replace(x, r"(?i)^<sup>[0-9]+</sup>", ""))
    return F.array_join(F.transform(parts, raise_first), "")
