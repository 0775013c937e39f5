"""Documents that hold word windows of benchmark items (op 4), with DataFrame functions alone.

Words are runs of letters, digits and characters from U+0080 on, A-Z lower-cased. A window is ``WINDOW`` consecutive words of an item, or
all of a shorter item's words. Winnowing with k-grams of ``K`` words keeps the least k-gram hash of every stretch of ``WINDOW`` words, in
items and documents alike: so whoever share a stretch of that length share its fingerprint, and stretches that overlap mostly share one.
Documents of which no fingerprint is an item's are done with after one pass. In the others, each matched stretch is compared word by word
with the items' windows, and the verified windows extend to hit spans by union. Shorter items are looked up by the hash of their words.

Null and empty texts have no words; long ones are one array of words and hashes. Ties: items are counted and listed once each. Items without words match nothing, nor do those with a null id unless ``null_ids`` is set:
then their windows count for n_hit and contaminated, and they for no item. Items of one id count once. Repeated document
rows are reported each, with equal values. Empty tables: no rows, or no hits. Columns are renamed on reading, so others cannot clash.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import BROADCAST_BYTES, bounded, saved, unfolded

WINDOW = 10
K = 6
#: Fixed value: what a word is made of, after lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _with_hashes(df: DataFrame) -> DataFrame:
    """Adds ``h``, a hash of each word of ``words``."""
    return df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))


def _at(array: str, i: Column, offset: int) -> Column:
    return F.get(array, i + offset if offset else i)


def _least_print(i: Column) -> Column:
    return F.least(*(_at("g", i, j) for j in range(WINDOW - K + 1)))


def _short_print(n: int) -> Callable[[Column], Column]:
    return lambda i: F.xxhash64(F.lit(n), *(_at("h", i, j) for j in range(n)))


def _prints(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds an array ``f{n}`` for each window length: the fingerprint of the window that starts at each word."""
    df = _with_hashes(df)
    if WINDOW in lengths:
        df = df.withColumn("g", F.transform("h", lambda x, i: F.xxhash64(x, *(_at("h", i, j) for j in range(1, K)))))
    for n in lengths:
        starts = F.when(F.size("h") >= n, F.sequence(F.lit(0), F.size("h") - n)).otherwise(F.array().cast("array<int>"))
        value = _least_print if n == WINDOW else _short_print(n)
        df = df.withColumn(f"f{n}", F.transform(starts, value))
    return df


def item_windows(benchmark: DataFrame, null_ids: bool = False) -> DataFrame:
    """Distinct (item_id as text, window as text, n words, fingerprint) of the items."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text").cast("string")).alias("words"))
    items = items.where((F.col("item_id").isNotNull() | F.lit(null_ids)) & (F.size("words") > 0))
    sized = _prints(items, [WINDOW])
    whole = F.xxhash64(F.size("words"), *(F.get("h", F.lit(j)) for j in range(WINDOW - 1)))  # of a shorter item; nulls beyond its end leave a hash as it is
    own = F.when(F.size("words") >= WINDOW, F.col(f"f{WINDOW}")).otherwise(F.array(whole))
    sized = sized.select("item_id", "words", F.least(F.size("words"), F.lit(WINDOW)).alias("n"), own.alias("prints"))
    # The outer form: for the other, Spark infers a filter on the array and moves it, with all that makes the array, below.
    exploded = sized.select("item_id", "words", "n", F.posexplode_outer("prints").alias("at", "print"))
    return exploded.select("item_id", F.array_join(F.slice("words", F.col("at") + 1, F.col("n")), " ").alias("window"), "n", "print").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, null_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_md5. What is joined is broadcast up to so many
    bytes."""
    small = lambda df, row_bytes: bounded(df, row_bytes, broadcast_bytes)
    windows = saved(item_windows(benchmark, null_ids), "item-windows")
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # 1 to WINDOW
    prints = small(windows.select(F.col("print").alias("p")).distinct(), 40)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("text_md5"), words(text).alias("words"))

    # One pass over all documents: which have a fingerprint of an item.
    every = _prints(rows, lengths) if lengths else rows.withColumn("h", F.array().cast("array<bigint>"))
    arrays = [F.array_distinct(f"f{n}") for n in lengths] or [F.array().cast("array<bigint>")]
    # Apart from the next line, or Spark counts the words anew for each fingerprint.
    own = every.select("doc_id", "text_md5", F.size("words").cast("long").alias("n_words"), F.concat(*arrays).alias("prints"))
    exploded = own.select("doc_id", "text_md5", "n_words", F.posexplode_outer("prints").alias("k", "print"))
    matched = (
        exploded.join(prints, F.col("print") == F.col("p"), "left")
        .groupBy("doc_id", "text_md5", "n_words")  # a task meets a document's rows one after another, so little of this is shuffled
        .agg(F.max(F.col("p").isNotNull()).alias("found"), F.sum(F.when(F.coalesce("k", F.lit(0)) == 0, 1).otherwise(0)).cast("long").alias("rows"))
    )
    seen = saved(matched, "matched")

    # Their words again, and every stretch with such a fingerprint, compared in full.
    keys = small(seen.where("found").select(F.col("doc_id").alias("s_id"), F.col("text_md5").alias("s_md5")), 100)
    some = rows.join(keys, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("text_md5") == F.col("s_md5")), "left_semi")
    again = _prints(some, lengths) if lengths else some
    stretches = None
    for n in lengths:
        part = again.select("doc_id", "text_md5", F.lit(n).alias("n"), F.posexplode_outer(f"f{n}").alias("at", "print"))
        stretches = part if stretches is None else stretches.union(part)
    if stretches is None:
        hits = seen.select("doc_id", "text_md5", F.lit(0).alias("n"), F.lit(0).alias("at"), F.lit("").alias("window")).where(F.lit(False))
    else:
        places = stretches.join(prints, F.col("print") == F.col("p"), "left_semi").groupBy(F.col("doc_id").alias("s_id"), F.col("text_md5").alias("s_md5")).agg(F.collect_list(F.struct("at", "n")).alias("places"))
        placed = rows.join(small(saved(places, "places"), 100 + 16 * F.size("places")), F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("text_md5") == F.col("s_md5")))
        window = F.transform("places", lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"), F.array_join(F.slice("words", x["at"] + 1, x["n"]), " ").alias("window")))
        near = placed.select("doc_id", "text_md5", window.alias("found")).select("doc_id", "text_md5", F.explode_outer("found").alias("x")).select("doc_id", "text_md5", "x.n", "x.at", "x.window")
        known = small(windows.select(F.col("window").alias("w"), F.col("n").alias("w_n")).distinct(), 40 + F.octet_length("w"))
        hits = near.join(known, (F.col("window") == F.col("w")) & (F.col("n") == F.col("w_n")), "left_semi").distinct()
    hits = saved(hits, "hits")

    by_doc = W.partitionBy("doc_id", "text_md5").orderBy("at", "n")
    reach = F.coalesce(F.max(F.col("at") + F.col("n")).over(by_doc.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = hits.withColumn("new", F.greatest(F.lit(0), F.col("at") + F.col("n") - F.greatest(F.col("at"), reach))).groupBy("doc_id", "text_md5").agg(F.sum("new").cast("long").alias("n_hit"))
    own = hits.select("doc_id", "text_md5", "window", "n").distinct().join(small(windows.select("item_id", F.col("window").alias("w"), F.col("n").alias("w_n")), 80 + F.octet_length("w")), (F.col("window") == F.col("w")) & (F.col("n") == F.col("w_n")))
    items = own.groupBy("doc_id", "text_md5").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_md5") == F.col("b.text_md5"))
    found = spans.alias("a").join(items.alias("b"), same).select(
        F.col("a.doc_id").alias("h_id"), F.col("a.text_md5").alias("h_md5"), "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    )
    # Repeated rows are one in ``seen``; they come back here.
    found = saved(found, "found")
    out = seen.join(small(found, 250), F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_md5") == F.col("h_md5")), "left")
    out = unfolded(out, "rows", seen.agg(F.max("rows")).head()[0] or 1)
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "text_md5",
    )
