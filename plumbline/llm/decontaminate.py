"""Benchmark decontamination: which windows of benchmark items occur in which documents.

A prefix-filtered containment join. A window must be contained whole, so one necessary token
is prefix enough, and the best one is the word that is rarest in the corpus. Windows are joined
to document words on it; the word's place in the window and the document's length bound the
places where the window fits; a hash of the document's words there and then the words themselves
verify containment. Only matches leave the tasks that read the documents, as long as the prefix
table is below Spark's broadcast threshold; beyond it Spark shuffles words with their neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from plumbline.llm.common import free_name, lower_ascii, numbered, written

WINDOW = 10
# No word: it marks the one row of each document that is kept whatever it contains.
MARK = " "


def words(text: Column) -> Column:
    """A-Z lower-cased; then runs of digits, letters and everything beyond ASCII. Null has none."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(parts, "")


def _windows(benchmark: DataFrame, size: int) -> DataFrame:
    """item_id and window (its words) for every window of every item."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).where("size(words) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))
    return items.select("item_id", "words", F.explode(starts).alias("at")).select(
        "item_id", F.slice("words", F.col("at") + 1, F.lit(size)).alias("window")
    )


def find_occurrences(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(occurrences, counts): ``occurrences(doc_id, start, length, item_id)`` of windows in
    documents, and ``counts(doc_id, n_words)`` with a row for every document row.

    Items shorter than ``size`` words are one window; items and documents without words match
    nothing. Items with equal windows each get their occurrences.
    """
    windows = written(_windows(benchmark, size).distinct(), "windows")
    texts = documents.select("doc_id", words(F.col("text")).alias("words"))
    # Rarity over the whole corpus, of the benchmark's words only.
    vocabulary = written(windows.select(F.explode("window").alias("word")).distinct(), "vocabulary")
    rarity = texts.select(F.explode("words").alias("word")).join(vocabulary, "word").groupBy("word").count()
    rarity = written(rarity, "rarity")
    shapes = windows.select("window").distinct().withColumn("id", F.xxhash64("window"))
    ranked = (
        shapes.select("id", "window", F.posexplode("window").alias("place", "word"))
        .join(rarity, "word")
        .groupBy("id", "window")
        .agg(F.count(F.lit(1)).alias("known"), F.min(F.struct("count", "place", "word")).alias("rarest"))
        .where("known = size(window)")  # a window with a word that no document has occurs nowhere
    )
    prefix = ranked.select(
        F.col("rarest.word").alias("word"), F.col("rarest.place").alias("place"),
        F.size("window").alias("length"), "id",
    )
    mark = documents.sparkSession.createDataFrame(
        [(MARK, 0, 0, 0)], "word string, place int, length int, id long"
    )
    prefix = written(prefix.unionByName(mark).coalesce(1), "prefix")
    marked = texts.select("doc_id", F.array_append("words", MARK).alias("words"))
    place = (
        marked.select("doc_id", "words", F.posexplode("words").alias("at", "word"))
        .join(prefix, "word")
        .withColumn("start", F.col("at") - F.col("place"))
        .where("start >= 0 and start + length < size(words)")
        .withColumn("found", F.slice("words", F.col("start") + 1, F.col("length")))
        .where("length = 0 or xxhash64(found) = id")
        .select("doc_id", "start", "length", "id", "found")
    )
    place = written(place, "places")
    counts = place.where("length = 0").select("doc_id", F.col("start").cast("long").alias("n_words"))
    hits = (
        place.where("length > 0")
        .join(windows.withColumn("id", F.xxhash64("window")), "id")
        .where("found = window")
        .select("doc_id", "start", "length", "item_id")
    )
    return hits, counts


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, a row per document row.

    A word inside any occurrence of a window is hit. Null and empty texts have no words. Every row
    is judged by its own text, also if it repeats a doc_id or has none.
    """
    row = F.struct(F.monotonically_increasing_id().alias("row"), F.col("doc_id")).alias("doc_id")
    hits, counts = find_occurrences(documents.select(row, "text"), benchmark, size)
    spans = hits.groupBy("doc_id", "start").agg(F.max("length").alias("length"))
    end = F.col("start") + F.col("length")
    before = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(end).over(before), F.lit(0))
    covered = (
        spans.withColumn("reached", reached)
        .withColumn("new", F.greatest(end - F.greatest("start", "reached"), F.lit(0)))
        .groupBy("doc_id")
        .agg(F.sum("new").alias("n_hit"))
    )
    # At most as many items as a document has words.
    items = hits.groupBy(F.col("doc_id").alias("id")).agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")
    )
    found = covered.join(items, F.col("doc_id").eqNullSafe(F.col("id"))).drop("doc_id")
    listed = F.coalesce(F.array_join("items", ","), F.lit(""))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return counts.join(found, F.col("doc_id").eqNullSafe(F.col("id")), "left").select(
        F.col("doc_id.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``documents`` in which no window of the benchmark occurs; all columns kept.

    Each row is judged by its own text, whatever its doc_id.
    """
    row = free_name(documents, "row")
    rows = numbered(documents, row)
    hits, _ = find_occurrences(rows.select(F.col(row).alias("doc_id"), "text"), benchmark, size)
    bad = hits.select(F.col("doc_id").alias(row)).distinct()
    return rows.join(bad, row, "left_anti").select(*documents.columns)
