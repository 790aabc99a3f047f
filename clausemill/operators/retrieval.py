"""Term tables, BM25, dense ranking and rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.functions.text import term_id, terms
from clausemill.operators.dense import partial_best
from clausemill.sources.staging import staged


#: Parts of the postings of one term.
SALTS = 16


def corpus_terms(units: DataFrame, key: str = "unit_id") -> DataFrame:
    """key, pos, term of each unit's text."""
    return units.select(key, F.posexplode(terms(F.col("text"))).alias("pos", "term"))


def vocabulary(rows: DataFrame, key: str = "unit_id") -> DataFrame:
    """term_id, n_terms, df: document frequency of each id, and how many terms share it."""
    each = rows.groupBy("term").agg(F.count_distinct(key).alias("df"))
    return each.groupBy(term_id(F.col("term")).alias("term_id")).agg(F.count(F.lit(1)).alias("n_terms"), F.sum("df").alias("df"))


def postings(rows: DataFrame, key: str = "unit_id", k1: float = 1.2, b: float = 0.75, average: float = 256.0) -> DataFrame:
    """key, term, weight: saturated term frequency against a fixed average length."""
    counts = rows.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    length = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / average))
    return counts.join(length, key).select(key, "term", weight.alias("weight"))


def query_terms(queries: DataFrame, key: str = "query_id") -> DataFrame:
    """key, term: the distinct terms of each query."""
    return queries.select(key, F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))


def top(scored: DataFrame, k: int, key: str = "query_id", unit: str = "unit_id") -> DataFrame:
    """The k best by score of each query, ties by unit; only k rows of a task reach the next."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), unit))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def sparse_topk(post: DataFrame, wanted: DataFrame, k: int, n_units: DataFrame) -> DataFrame:
    """query_id, unit_id, score, rank: BM25 with idf ln(1 + (N - df + 0.5) / (df + 0.5)); n_units(n) has one row.

    Only postings of asked-for terms are joined; document frequency is counted on those alone. Postings of a term meet
    the queries that ask for it in SALTS parts, so a term that most units hold is no single task.
    """
    asked = post.join(wanted.select("term").distinct(), "term", "left_semi")
    df = asked.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(F.broadcast(n_units)).select("term", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    wanted = wanted.join(idf, "term").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = asked.withColumn("salt", F.pmod(F.xxhash64("unit_id"), F.lit(SALTS)).cast("int")).join(wanted, ["term", "salt"])
    score = F.round(F.sum(F.col("weight") * F.col("idf")), 6)
    return top(hits.groupBy("query_id", "unit_id").agg(score.alias("score")), k)


def build_index(units: DataFrame, key: str = "unit_id", k1: float = 1.2, b: float = 0.75, average: float = 256.0, parts: int = 8) -> DataFrame:
    """Postings to be searched again and again, written once: key, block, term, weight.

    Texts are read once and shuffled once, by key; the texts of a key are one unit, whose sorted terms are counted by their
    runs, inside the row, so that no table of a task's terms is held. A block holds units of about the same length (four
    steps to a doubling), in `parts` parts, so that the largest weight of a term in a block is close to those of its units. A
    null text has no terms.
    """
    rows = units.select(key, "text").repartition(key).groupBy(key).agg(F.collect_list("text").alias("texts"))
    rows = rows.select(key, F.array_sort(F.flatten(F.transform("texts", terms))).alias("terms")).withColumn("n", F.size("terms")).where("n > 0")
    starts = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i == 0) | (F.get("terms", i) != F.get("terms", i - 1)))
    rows = rows.withColumn("starts", starts)
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array("n"))
    counts = F.zip_with("starts", ends, lambda i, j: F.struct(F.get("terms", i).alias("term"), (j - i).alias("tf")))
    n = F.col("n")
    block = F.floor(F.log2(n + 1.0) * 4).cast("int") * parts + F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    each = rows.select(key, n.alias("n"), block.alias("block"), F.explode(counts).alias("c")).select(key, "n", "block", "c.term", "c.tf")
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / average))
    return staged(each.select(key, "block", "term", weight.alias("weight")))


def pruned_topk(index: DataFrame, wanted: DataFrame, k: int, n_units: DataFrame, share: float = 0.2) -> DataFrame:
    """query_id, unit_id, score, rank: what sparse_topk gives, with fewer postings scored; exact.

    1. The largest weight of each asked-for term in each block bounds what the term can add there.
    2. A query's rarest terms, up to `share` of the units in postings, find k units; their whole scores are taken, and the
       least of them is a score that the k best reach.
    3. The query's terms of least bound, as many as together stay below that score, find no unit alone: units come from the
       postings of the others. One whose score so far and the bounds of the rest in its block together stay below it goes.
    4. Units that are left get the rest of their scores by unit and term.

    A query with fewer than k units is scored in full. Bounds are per term and block, scores needed per query, so all but
    the postings is small; postings of a term meet queries in SALTS parts.
    """
    names = staged(wanted.select("term").distinct().select("term", F.monotonically_increasing_id().alias("t")))
    salt = F.pmod(F.xxhash64("unit_id"), F.lit(SALTS)).cast("int")
    asked = staged(index.join(names, "term").select("unit_id", "block", "t", "weight", salt.alias("salt")))
    impacts = staged(asked.groupBy("t", "block").agg(F.count(F.lit(1)).alias("df"), F.max("weight").alias("most")))
    per_term = impacts.groupBy("t").agg(F.sum("df").alias("df"), F.max("most").alias("most")).crossJoin(F.broadcast(n_units))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rarest, least = Window.partitionBy("query_id").orderBy("df", "t"), Window.partitionBy("query_id").orderBy("bound", "t")
    per_term = per_term.select("t", "df", idf.alias("idf"), (idf * F.col("most")).alias("bound"), (share * F.col("n")).alias("budget"))
    ask = wanted.join(names, "term").join(per_term, "t").withColumns({"upto": F.sum("df").over(rarest), "nth": F.row_number().over(rarest), "adds": F.sum("bound").over(least)})
    ask = staged(ask)

    def scored(some: DataFrame) -> DataFrame:
        salted = some.select("query_id", "t", "idf", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        hits = asked.join(salted, ["t", "salt"])
        return hits.groupBy("query_id", "unit_id", "block").agg(F.sum(F.col("weight") * F.col("idf")).alias("score"))

    def completed(units: DataFrame, some: DataFrame) -> DataFrame:
        pairs = units.select("query_id", "unit_id").join(some.select("query_id", "t", "idf"), "query_id")
        return pairs.join(asked.select("unit_id", "t", "weight"), ["unit_id", "t"]).groupBy("query_id", "unit_id").agg(F.sum(F.col("weight") * F.col("idf")).alias("more"))

    found = top(scored(ask.where("upto <= budget or nth = 1")), k)
    whole = completed(found, ask).groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("more")).alias("reach"))
    reach = staged(whole.select("query_id", F.coalesce(F.col("reach") - 1e-5, F.lit(0.0)).alias("reach")))
    ask = ask.join(reach, "query_id")
    finds, adds = ask.where("adds >= reach"), ask.where("adds < reach")
    rest = adds.join(impacts.select("t", "block", "most"), "t").groupBy("query_id", "block").agg(F.sum(F.col("idf") * F.col("most")).alias("rest"))
    so_far = scored(finds).join(rest, ["query_id", "block"], "left").join(reach, "query_id")
    left = staged(so_far.where(F.col("score") + F.coalesce("rest", F.lit(0.0)) >= F.col("reach")).select("query_id", "unit_id", "score"))
    total = left.join(completed(left, adds), ["query_id", "unit_id"], "left")
    return top(total.select("query_id", "unit_id", F.round(F.col("score") + F.coalesce("more", F.lit(0.0)), 6).alias("score")), k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit_vectors(vectors: DataFrame, width: int) -> DataFrame:
    """vec_id, unit: vectors of the right width and a norm above zero, scaled to length one."""
    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    ok = vectors.where((F.size("embedding") == width)).withColumn("norm", norm).where("norm > 0")
    return ok.select("vec_id", F.transform("embedding", lambda x: x / F.col("norm")).alias("unit"))


def bad_vectors(vectors: DataFrame, width: int) -> DataFrame:
    """rule, key: vectors that are missing, of another width, not finite or of no length, which unit_vectors leaves out."""
    norm = dot(F.col("embedding"), F.col("embedding"))
    rule = F.when(F.col("embedding").isNull(), "missing").when(F.size("embedding") != width, "wrong_width").when(norm.isNull() | F.isnan(norm), "not_finite").when(norm == 0, "zero_length")
    return vectors.select(rule.alias("rule"), F.col("vec_id").cast("string").alias("key")).where("rule is not null")


def hybrid_search(sparse: DataFrame, dense: DataFrame, units: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, unit_id, score, sparse_score, dense_score and the columns of units: both rankings cut at k, fused
    by reciprocal rank and cut at k again; a limb that does not hold the unit scores 0."""
    a, b = sparse.where(F.col("rank") <= k), dense.where(F.col("rank") <= k)
    fused = rrf(a, b, k)
    by = ["query_id", "unit_id"]
    scores = fused.join(a.select(*by, F.col("score").alias("sparse_score")), by, "left").join(b.select(*by, F.col("score").alias("dense_score")), by, "left")
    return scores.na.fill(0.0, ["sparse_score", "dense_score"]).join(units, "unit_id")


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, most: int = 4096) -> DataFrame:
    """query_id, unit_id, score, rank: cosine of every unit vector with the stated queries(query_id, unit), in blocks.

    Scores are products of matrices, and every block hands on k units a query (see dense.partial_best, and for `most`).
    """
    return top(partial_best(vectors, queries, k, most), k)


def rrf(a: DataFrame, b: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """query_id, unit_id, score, rank: reciprocal-rank fusion of two rankings, ties by the hash of the unit."""
    left, right = a.select("query_id", "unit_id", F.col("rank").alias("ra")), b.select("query_id", "unit_id", F.col("rank").alias("rb"))
    part = lambda c: F.coalesce(1.0 / (F.lit(constant) + F.col(c)), F.lit(0.0))
    both = left.join(right, ["query_id", "unit_id"], "full_outer").select("query_id", "unit_id", F.round(part("ra") + part("rb"), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.sha2(F.col("unit_id").cast("string"), 256)))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)


def sanitize(queries: DataFrame, prefix: str = "query: ") -> DataFrame:
    """query_id, sparse_text, dense_text, error: word tokens joined by a space; no token is an error."""
    words = F.array_join(F.regexp_extract_all("text", F.lit(r"(?U)(\w+)")), " ")
    return queries.select("query_id", words.alias("sparse_text"), F.concat(F.lit(prefix), words).alias("dense_text"), F.when(words == "", "retrieval_query_empty").alias("error"))


def assign_batches(rows: DataFrame, key: str, size: int, group: str) -> DataFrame:
    """rows with their batch of at most `size` within a group."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(key)) - 1) / size))


def repeated_queries(asks: DataFrame) -> DataFrame:
    """conv_id, searches, cache_hits: a query asked before in a run is answered from before, never across runs."""
    nth = F.row_number().over(Window.partitionBy("conv_id", F.sha2("text", 256)).orderBy("turn"))
    return asks.withColumn("nth", nth).groupBy("conv_id").agg(F.count_if(F.col("nth") == 1).alias("searches"), F.count_if(F.col("nth") > 1).alias("cache_hits"))


def phrase_rules(queries: DataFrame, longest: int = 500) -> DataFrame:
    """rule, key: blank phrases (null ones too) and those longer than allowed."""
    blank = F.coalesce(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("")) == ""
    rule = F.when(blank, "phrase_empty").when(F.length("text") > longest, "phrase_too_long")
    return queries.select(rule.alias("rule"), F.col("query_id").cast("string").alias("key")).where("rule is not null")


def spaces_agree(pairs: DataFrame, least: float = 0.99) -> DataFrame:
    """pairs(key, a, b) with agree: cosine of at least `least`; empty or unequal vectors never agree."""
    cosine = F.try_divide(dot(F.col("a"), F.col("b")), F.sqrt(dot(F.col("a"), F.col("a"))) * F.sqrt(dot(F.col("b"), F.col("b"))))
    ok = (F.size("a") == F.size("b")) & (F.size("a") > 0)
    return pairs.select("key", F.coalesce(F.when(ok, cosine >= least), F.lit(False)).alias("agree"))


def lookup(keys: DataFrame, units: DataFrame, snippet: int = 300) -> DataFrame:
    """unit_id, snippet, error of each key: the first row of a unit that has more; an absent unit is an error."""
    held = units.groupBy("unit_id").agg(F.min("text").alias("text"), F.lit(True).alias("held"))
    joined = keys.select("unit_id").distinct().join(held, "unit_id", "left")
    return joined.select("unit_id", F.substring("text", 1, snippet).alias("snippet"), F.when(F.col("held").isNull(), "unit_not_found").alias("error"))


def place_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """request_id, n, error: answers are placed by index 0 to n - 1; a missing, foreign or repeated one is refused."""
    r = responses.groupBy("request_id").agg(F.count(F.lit(1)).alias("got"), F.count_distinct("idx").alias("distinct"), F.min("idx").alias("low"), F.max("idx").alias("high"))
    joined = requests.select("request_id", "n").join(r, "request_id", "left")
    got = F.coalesce("got", F.lit(0))
    error = F.when((F.col("low") < 0) | (F.col("high") >= F.col("n")), "index_out_of_range").when(F.col("distinct") < F.col("got"), "index_repeated").when(got < F.col("n"), "index_missing")
    return joined.select("request_id", "n", error.alias("error"))


def query_reuse(asks: DataFrame, run: str, key: list[str], order: str) -> DataFrame:
    """asks with hit and source: a query asked before in its run, for the same input and snapshot, is answered from its
    first asking; never across runs. key names the columns that make a query the same."""
    first = Window.partitionBy(run, *key).orderBy(order)
    source = F.first(order).over(first)
    return asks.withColumn("hit", F.row_number().over(first) > 1).withColumn("source", F.when(F.col("hit"), source))


def token_bill(batches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, requests, tokens: the tokens reported by the batches of a group, null when none reported any."""
    return batches.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens"))
