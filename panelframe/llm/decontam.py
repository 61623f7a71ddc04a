"""Benchmark decontamination as a prefix-filtered set join, in DataFrame expressions only.

An item's windows are its runs of 13 consecutive words (a shorter item is one window). A document
holds a window only if it holds every shingle of it, so it is enough to join on one necessary
shingle, the rarest by corpus count. Neighbouring windows share their rarest shingle, so an
item is cut into few (shingle, position, range of windows) entries. A joined entry is verified by
extending the match to both sides within the reach of its windows: length and position bounds cut
it off, and the windows that fit into the matched stretch are exact occurrences.

Null text and null or empty items have no words; a document without words has zeros. Each row is judged by itself and gives a
row, repeated rows and null doc_ids too. Of shingles that are equally rare the one with the least hash and position is taken. Items
with the same item_id are taken one by one; equal items count once. Item texts with a null item_id still mark words but have no id
to list. Very long texts are searched whole. Without documents there are no rows, without items no hits. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, staged

WINDOW, SHINGLE = 13, 4
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]++"
#: Entries go to every executor up to this many bytes, as measured; beyond it they are joined by key. Both ways find the same.
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    """A-Z lower-cased, then the runs of [0-9a-z] and non-ASCII code points."""
    text = F.coalesce(text, F.lit(""))
    # lower() is several times faster than translate() and the same for ASCII, but it changes other letters too.
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.array_remove(F.split(low, WORD_BREAK, -1), "")


def _key(array: Column, i: Column, m: int) -> Column:
    """Hash of the m words that begin at index i (from 0)."""
    return F.xxhash64(F.lit(m), *[F.get(array, i + j) for j in range(m)])


def item_entries(items: DataFrame, counts: DataFrame | None) -> DataFrame:
    """(key, m, q, lo, hi, w, item_words, item_id): windows lo..hi of the item are found by the m-word shingle at q. item_words are
    cut to what these windows hold, and q, lo, hi count from there."""
    span = items.withColumn("n", F.size("item_words")).withColumn("w", F.least(F.lit(WINDOW), "n")).withColumn("m", F.least(F.lit(SHINGLE), "n"))
    shingles = span.select("item_row", "n", "w", "m", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("m"))).alias("q"), "item_words")
    keyed = shingles.withColumn("key", _key_by_m("item_words", "q", "m"))
    if counts is None:
        return keyed
    counted = keyed.drop("item_words").join(counts, "key", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    starts = counted.withColumn("s", F.explode(F.sequence(F.greatest(F.lit(0), F.col("q") + F.col("m") - F.col("w")), F.least(F.col("q"), F.col("n") - F.col("w")))))
    best = starts.groupBy("item_row", "s").agg(F.min(F.struct("c", "key", "q", "m", "w")).alias("best"))
    return best.groupBy("item_row", "best.key", "best.q", "best.m", "best.w").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).join(items, "item_row").select(
        "key", "m", (F.col("q") - F.col("lo")).alias("q"), F.lit(0).alias("lo"), (F.col("hi") - F.col("lo")).alias("hi"), "w",
        F.slice("item_words", F.col("lo") + 1, F.col("hi") - F.col("lo") + F.col("w")).alias("item_words"), "item_id",
    )


def _key_by_m(array: str, i: str, m: str) -> Column:
    out = _key(F.col(array), F.col(i), SHINGLE)
    for k in range(1, SHINGLE):
        out = F.when(F.col(m) == k, _key(F.col(array), F.col(i), k)).otherwise(out)
    return out


def _positions(docs: DataFrame, lengths: list[int], *more: str) -> DataFrame:
    """A row for each word position and shingle length. Inside generated code the words go along by
    reference; the outer explode keeps the optimizer from adding a filter that splits every text twice."""
    at = docs.select(*more, "words", F.posexplode_outer("words").alias("p", "_"))
    if len(lengths) == 1:
        return at.withColumn("key", _key(F.col("words"), F.col("p"), lengths[0]))
    keys = F.array(*[_key(F.col("words"), F.col("p"), m) for m in lengths])
    return at.select(*more, "words", "p", F.posexplode(keys).alias("which", "key"))


def _agree(a: Column, b: Column, n: Column) -> Column:
    """How many of the first n elements of both arrays agree before the first that does not."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False)
    return F.when(first > 0, (first - 1).cast("int")).otherwise(n)


def hits(docs: DataFrame, entries: DataFrame, lengths: list[int]) -> DataFrame:
    """(row, doc_id, row_key, first_row, n_words, item_id, span): words span.a..span.b-1 of the document lie in
    occurrences of windows of the item. Each document also has a row (first_row) without a join partner's
    need, so that documents without hits stay; item_id and span are null where nothing was verified."""
    x = _positions(docs, lengths, "row", "doc_id", "row_key").join(entries.withColumnRenamed("m", "len"), "key", "left")
    x = x.withColumn("first_row", F.coalesce(F.col("p") == 0, F.lit(True)) & (F.col("which") == 0 if len(lengths) > 1 else F.lit(True)))
    x = x.withColumn("d", F.col("p") - F.col("q")).withColumn("n", F.size("words"))
    # Bounds: the windows must lie inside the document.
    x = x.withColumn("lo", F.greatest("lo", -F.col("d"))).withColumn("hi", F.least("hi", F.col("n") - F.col("w") - F.col("d"))).where("first_row or lo <= hi")
    # A key may have several partners: only one of its rows stands for the document (any: their counts are the same).
    left, right = F.col("q") - F.col("lo"), F.col("hi") + F.col("w") - F.col("q")
    before = F.reverse(F.slice("words", F.col("d") + F.col("lo") + 1, left)), F.reverse(F.slice("item_words", F.col("lo") + 1, left))
    after = F.slice("words", F.col("p") + 1, right), F.slice("item_words", F.col("q") + 1, right)
    fits = F.col("lo") <= F.col("hi")
    x = x.withColumn("back", F.when(fits, _agree(*before, left))).withColumn("ahead", F.when(fits, _agree(*after, right)))
    x = x.withColumn("first", F.when(fits, F.greatest(F.col("lo"), F.col("q") - F.col("back")))).withColumn("last", F.least(F.col("hi"), F.col("q") + F.col("ahead") - F.col("w")))
    # No filter here: the optimizer would move it into the join, whose code could then not be generated.
    exact = fits & F.expr("first <= last and ahead >= len")
    span = F.struct((F.col("first") + F.col("d")).alias("a"), (F.col("last") + F.col("w") + F.col("d")).alias("b"))
    return x.select("row", "doc_id", "row_key", "first_row", F.greatest("n", F.lit(0)).cast("long").alias("n_words"), F.when(exact, F.col("item_id")).alias("item_id"), F.when(exact, span).alias("span"))


def _union_length(spans: Column) -> Column:
    """Positions covered by sorted (a, b) spans."""

    def add(acc: Column, x: Column) -> Column:
        return F.struct(F.greatest(acc["end"], x["b"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(acc["end"], x["a"]))).alias("n"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), add, lambda acc: acc["n"].cast("long"))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, row_key, n_words, n_hit, items, contaminated) for each row of docs.

    items lists the ids, as strings, of the items with occurring windows; row_key is
    xxhash64(doc_id, text). docs: doc_id, text. items: item_id, text. Two passes over docs (shingle
    counts, then hits), each a map with an aggregation by shingle or row; texts are not shuffled.
    """
    short = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), words(F.col("text")).alias("words"))
    bench = staged(items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("item_words")).where(F.size("item_words") > 0).withColumn("item_row", F.xxhash64("item_id", "item_words")).dropDuplicates(["item_row"]), "bench")
    shingles = item_entries(bench, None)
    lengths = sorted(r.m for r in shingles.select("m").distinct().collect()) or [SHINGLE]  # at most SHINGLE values
    known = staged(shingles.select("key").distinct(), "bench-keys")
    counts = _positions(short, lengths).select("key").join(F.broadcast(known) if 16 * known.count() <= BROADCAST_BYTES else known, "key").groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    entries = staged(item_entries(bench, counts), "bench-entries")
    size = entries.agg(F.sum(F.octet_length(F.array_join("item_words", " ")) + 16 * F.size("item_words") + 64).alias("n")).first()["n"] or 0
    discard(known)
    found = hits(short.withColumn("row", F.monotonically_increasing_id()), F.broadcast(entries) if size <= BROADCAST_BYTES else entries, lengths)
    out = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("row_key").alias("row_key"), F.max("n_words").alias("n_words"),
        _union_length(F.array_sort(F.collect_set("span"))).alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"),
    ).drop("row")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
