"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item contributes windows: runs of ``window`` consecutive words, or
the whole item if it is shorter. A document contains a window only if it has
all of its words, so one word of each window is prefix enough: the rarest one
by its count over all documents. Documents' words are looked up among those
prefix words; a word that is one fixes where the window would have to begin.
Length and position bounds (the window must fit into the document at that
place) come first, then all words are compared, so what is left is exact.

Everything is DataFrame operations, and the words of a document leave its row
only where a prefix word matched and the comparison succeeded. The windows are
broadcast in blocks of at most ``block_windows`` windows and ``block_bytes``
bytes, so that what is broadcast stays bounded however large the benchmark is;
each further block is another pass over the documents. The items that hold a
window are no part of that: windows with the same items share a number, and
only documents with hits are joined with the items behind it.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folia.llm.common import checkpointed, local_table, unused

#: Not a word character, so no word equals it; stands for the document itself among its words.
_SELF = "\x00"

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of letters and digits (characters outside ASCII count as letters), ``A-Z`` in lower case; none for null."""
    text = F.coalesce(text, F.lit(""))
    small = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.regexp_extract_all(small, F.lit(_WORD), F.lit(0))


def windows(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """Distinct windows: ``words`` (array), ``size``, ``items`` (ids as strings that have it, sorted) and ``items_id``, a number for these."""
    found = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    every = found.withColumn("size", size).select("item", "size", "w", F.explode(starts).alias("at")).select("item", "size", F.slice("w", F.col("at"), F.col("size")).alias("words"))
    return every.groupBy("words", "size").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("items_id", F.xxhash64("items"))


def _in_blocks(table: DataFrame, rows: int, per_block: int, size: int = 0, block_bytes: int = 1) -> list[DataFrame]:
    """A table in parts of about so many rows and bytes."""
    blocks = max(1, -(-rows // per_block), -(-size // block_bytes))
    if blocks == 1:
        return [table]
    part = F.pmod(F.xxhash64(*table.columns), F.lit(blocks))
    return [table.where(part == i) for i in range(blocks)]


def rarity(docs: DataFrame, vocabulary: DataFrame, text_col: str, rows: int, per_block: int) -> DataFrame:
    """(word, n): how often each word of ``vocabulary`` stands in the documents, counted over all of them."""
    every = docs.select(F.explode(words(F.col(text_col))).alias("word"))
    counted = [every.join(F.broadcast(part), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n")) for part in _in_blocks(vocabulary, rows, per_block)]
    return vocabulary.join(reduce(DataFrame.unionByName, counted), "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: int = 20, block_windows: int = 100_000, block_bytes: int = 64_000_000, broadcast_items: int = 1_000_000) -> DataFrame:
    """What of the benchmark each document holds, one row for each row of ``docs``.

    ``n_words``; ``n_hit``, the words inside any occurrence of a window;
    ``n_items``, the items with occurring windows; ``items``, their ids as
    strings, sorted; ``contaminated``: ``n_hit > 0 and share * n_hit >=
    n_words``; ``text_hash``, which names the row together with the id. Null and
    empty texts have no words; items without words have no windows; null item
    ids are not listed. Repeated rows get equal results. An empty benchmark
    leaves every document clean; no documents, no rows.
    """
    known = checkpointed(windows(benchmark, window, item_col, item_text_col))
    vocabulary = known.select(F.explode("words").alias("word")).distinct()
    n_words = vocabulary.count()
    n_windows, size = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.array_join("words", " "))), F.lit(0))).first()
    sets = known.groupBy(F.col("items_id").alias("__items_id")).agg(F.first("items").alias("__items"))
    small = (sets.agg(F.sum(F.size("__items"))).first()[0] or 0) <= broadcast_items
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    plan = local_table(spark, [(_SELF, None, None, None, None)], "word string, shift int, size int, words array<string>, items_id long")
    passes = [plan]
    if n_windows:
        counts = checkpointed(rarity(docs, vocabulary, text_col, n_words, block_windows))
        placed = known.select("words", "size", "items_id", F.posexplode("words").alias("shift", "word")).join(counts, "word")
        rarest = Window.partitionBy("words").orderBy("n", "word", "shift")
        prefix = checkpointed(placed.withColumn("r", F.row_number().over(rarest)).where("r = 1").select("word", "shift", "size", "words", "items_id"))
        passes = [part.unionByName(plan) for part in _in_blocks(prefix, n_windows, block_windows, 3 * size, block_bytes)]

    def one(part: DataFrame, number: int) -> DataFrame:
        part = part.select(*[F.col(c).alias(f"p_{c}") for c in ("word", "shift", "size", "words", "items_id")])
        opened = source.select("id", "text_hash", words(F.col("text")).alias("w")).select("id", "text_hash", "w", F.posexplode(F.concat(F.array(F.lit(_SELF)), F.col("w"))).alias("pos", "word"))
        start = F.col("pos") - 1 - F.col("p_shift")  # of the window, words from 0
        fits = (start >= 0) & (start + F.col("p_size") <= F.size("w"))
        same = F.when(fits, F.slice("w", F.greatest(start + 1, F.lit(1)), F.col("p_size")) == F.col("p_words"))
        met = opened.join(F.broadcast(part), (F.col("word") == F.col("p_word")) & (F.col("p_size").isNull() | same))
        itself = F.col("p_size").isNull()
        return met.select("id", "text_hash", F.when(itself, F.size("w")).alias("n_words"), F.when(itself & F.lit(number == 0), 1).alias("row"), F.when(~itself, F.struct(start.alias("a"), (start + F.col("p_size")).alias("b"))).alias("hit"), "p_items_id")

    met = reduce(DataFrame.unionByName, [one(part, i) for i, part in enumerate(passes)])
    by_doc = met.groupBy("id", "text_hash").agg(
        F.max("n_words").cast("bigint").alias("n_words"),
        F.count("row").cast("int").alias("rows"),
        F.array_sort(F.collect_set("hit")).alias("hits"),
        F.collect_set("p_items_id").alias("sets"),
    )
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, hit: F.struct(F.greatest(acc["end"], hit["b"]).alias("end"), (acc["n"] + F.greatest(hit["b"] - F.greatest(acc["end"], hit["a"]), F.lit(0))).alias("n")),
    )["n"]
    counted = by_doc.withColumn("n_hit", covered.cast("bigint")).drop("hits")
    # one row for each document and set of items, without one for a document without hits
    opened = counted.withColumn("__set", F.explode_outer("sets")).drop("sets")
    met = opened.join(F.broadcast(sets) if small else sets, F.col("__set") == F.col("__items_id"), "left")
    told = met.groupBy("id", "text_hash", "n_words", "n_hit", "rows").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("items"))
    return told.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows")))).select(
        F.col("id").alias(id_col), "text_hash", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items",
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 500_000, **settings) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, columns as they are.

    Null and empty texts and null ids stay, repeated rows go or stay together,
    and an empty benchmark or table leaves all rows as they are.
    """
    id_name, hash_name = unused("__id", docs), unused("__hash", docs)
    found = checkpointed(contamination(docs, benchmark, id_col, text_col, **settings).where("contaminated").select(F.col(id_col).alias(id_name), F.col("text_hash").alias(hash_name)).distinct())
    small = found.count() <= broadcast_rows
    named = F.broadcast(found) if small else found
    return docs.join(named, docs[id_col].eqNullSafe(F.col(id_name)) & (F.xxhash64(docs[text_col]) == F.col(hash_name)), "left_anti")
