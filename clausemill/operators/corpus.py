"""Building and checking a corpus of units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def amendments_in_window(amendments: DataFrame, acts: DataFrame) -> DataFrame:
    """act_id, amendment_id of the amendments after an act's status date and up to its target date."""
    joined = amendments.join(acts, "act_id").where("amended_on > status_date and amended_on <= target_date")
    return joined.select("act_id", "amendment_id").distinct()


def drift(recorded: DataFrame, reported: DataFrame) -> DataFrame:
    """rule, key, detail: recorded pairs that are not reported and reported ones not recorded."""
    a, b = recorded.distinct().withColumn("a", F.lit(1)), reported.distinct().withColumn("b", F.lit(1))
    both = a.join(b, ["act_id", "amendment_id"], "full_outer").where("a is null or b is null")
    return both.select(F.when(F.col("a").isNull(), "not_recorded").otherwise("not_reported").alias("rule"), F.col("act_id").cast("string").alias("key"), F.col("amendment_id").cast("string").alias("detail"))


def printings(units: DataFrame) -> DataFrame:
    """units(act_id, pos, article) with printing 1..n where an article is repeated, else null."""
    n = F.count(F.lit(1)).over(Window.partitionBy("act_id", "article"))
    nth = F.row_number().over(Window.partitionBy("act_id", "article").orderBy("pos"))
    return units.select("act_id", "pos", "article", F.when(n > 1, nth).alias("printing"))


def duplicate_ids(units: DataFrame, key: str) -> DataFrame:
    """rule, key, detail: ids that occur more than once."""
    got = units.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return got.select(F.lit("duplicate_id").alias("rule"), F.col(key).cast("string").alias("key"), F.col("n").cast("string").alias("detail"))


def delta_plan(new: DataFrame, stored: DataFrame) -> DataFrame:
    """unit_id, action: embed (new or changed text), update_metadata (same text, other payload_hash), skip (same in both)
    or purge (no longer there). Tables without payload_hash only compare texts."""
    more = "payload_hash" in new.columns and "payload_hash" in stored.columns
    of = lambda df, h, p: df.select("unit_id", F.col("content_hash").alias(h), (F.col("payload_hash") if more else F.lit("")).alias(p))
    same = F.col("h") == F.col("g")
    action = F.when(F.col("h").isNull(), "purge").when(same & F.col("p").eqNullSafe(F.col("q")), "skip").when(same, "update_metadata").otherwise("embed")
    return of(new, "h", "p").join(of(stored, "g", "q"), "unit_id", "full_outer").select("unit_id", action.alias("action"))


def build_report(plan: DataFrame) -> DataFrame:
    """act (null: all), total, skipped, embedded, purged."""
    n = lambda a: F.count_if(F.col("action") == a)
    return plan.rollup("act").agg(F.count_if(F.col("action") != "purge").alias("total"), n("skip").alias("skipped"), n("embed").alias("embedded"), n("purge").alias("purged"))


def digest_in_parts(rows: DataFrame, keys: list[str], line: Column, parts: int = 256) -> DataFrame:
    """keys, digest of the sorted lines of each group, in two steps, so that no row holds a whole group.

    Lines are dealt to `parts` parts by the first two hex digits of their SHA-256; each part's sorted lines are hashed,
    then the part digests in order, with their numbers. The order of the rows does not matter.
    """
    part = F.conv(F.substring(F.sha2("line", 256), 1, 2), 16, 10).cast("int") % parts
    some = rows.select(*keys, line.alias("line")).withColumn("part", part).groupBy(*keys, "part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("h"))
    held = some.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", "h"))).alias("all"))
    return held.select(*keys, F.sha2(F.array_join(F.transform("all", lambda x: F.concat_ws(":", x["part"].cast("string"), x["h"])), "\n"), 256).alias("digest"))


def unit_digest(units: DataFrame) -> DataFrame:
    """act, digest over the locators and hashes of each act, whatever their order."""
    return digest_in_parts(units, ["act"], F.concat_ws(" ", "locator", "content_hash"))


def pages_to_text(pages: DataFrame) -> DataFrame:
    """page_id, text, title: tags become spaces, the common entities are decoded and white space is folded."""
    text = F.regexp_replace("html", r"(?s)<(script|style)\b.*?</(?:script|style)>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, "<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    text = F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))
    return pages.select("page_id", text.alias("text"), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))


def locator_catalogue(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    """act, n_rows, n_malformed: locators parsed by an anchored pattern with the act as its first group."""
    act = F.regexp_extract(column, f"^{pattern}$", 1)
    return rows.groupBy(F.when(act != "", act).alias("act")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(act == "").alias("n_malformed"))


def act_force(acts: DataFrame) -> DataFrame:
    """acts with force: in_force, not_in_force or undetermined, and whether it admits the act's provisions."""
    force = F.when(F.col("in_force") == "IN_FORCE", "in_force").when(F.col("in_force") == "NOT_IN_FORCE", "not_in_force").otherwise("undetermined")
    return acts.withColumn("force", force).withColumn("admitted", F.col("force") == "in_force")


def repeats(printed: DataFrame) -> DataFrame:
    """act_id, article, printings of the articles that an act has more than once."""
    return printed.groupBy("act_id", "article").agg(F.count(F.lit(1)).alias("printings")).where("printings > 1")


def repeat_drift(found: DataFrame, pinned: DataFrame) -> DataFrame:
    """rule, key, detail: repeated articles that are not pinned, pinned ones that are not repeated, and other counts."""
    both = found.join(pinned.withColumnRenamed("printings", "pinned"), ["act_id", "article"], "full_outer")
    rule = F.when(F.col("pinned").isNull(), "repeat_not_pinned").when(F.col("printings").isNull(), "pin_not_repeated").when(F.col("printings") != F.col("pinned"), "printings_differ")
    return both.select(rule.alias("rule"), F.concat_ws("/", "act_id", "article").alias("key"), F.concat_ws(":", F.col("printings").cast("string"), F.col("pinned").cast("string")).alias("detail")).where("rule is not null")


def build_locator(prefix: str, act: str = "act", article: str = "article", printing: str = "printing") -> Column:
    """prefix act #article=<article>, and &printing=<n> where there is one."""
    return F.concat(F.lit(prefix), act, F.lit("#article="), article, F.coalesce(F.concat(F.lit("&printing="), F.col(printing).cast("string")), F.lit("")))


def parse_locator(column: str, prefix: str) -> Column:
    """act, article, printing of a locator as a struct; null where it is none."""
    pattern = f"^\\Q{prefix}\\E([^#]+)#article=([^&]+)(?:&printing=([0-9]+))?$"
    part = lambda i: F.regexp_extract(column, pattern, i)
    return F.when(part(1) != "", F.struct(part(1).alias("act"), part(2).alias("article"), F.nullif(part(3), F.lit("")).cast("int").alias("printing")))
