"""Benchmark decontamination: short items inside long documents, by MinHash containment.

Sets are the distinct ``shingle``-word shingles (ASCII white space separates words, A-Z is lower-cased; a shorter text is one
shingle). An item is found in a document if at least ``percent`` per cent of the item's shingles are in the document.

The search keeps, for an item of q shingles, the MinHash sketch of its q - ceil(t * q) + 1 smallest hash values. A document
that holds the share t of the item's shingles holds at least one of the sketch, whatever its own length, so long documents
need no longer signatures and no item is missed. Items are partitioned by size (powers of two); the largest value of a
partition's sketches is its threshold, and a partition is searched only with the hash values of a document up to its own
threshold. The larger the items of a partition, the smaller the part of their hashes that the sketches hold, and so the
threshold; partitions of many short items have thresholds near the maximum. Found pairs are verified by the exact intersection of the full shingle sets.

All steps are DataFrame expressions. Defined results: null texts and texts without words hold nothing, and items without
words are never found; rows that share a document id are looked at one by one, and the best containment counts; null ids are
ids of their own; items given twice are reported once for an id (the best); very long texts are searched whole; an item of fewer
words than a shingle is found only in a document that is equal to it word by word; empty tables give an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smoothspan.llm.scratch import cut


@dataclass(frozen=True)
class ContainmentSettings:
    """``broadcast_rows``: most rows that are broadcast; larger tables are joined by a shuffle."""

    shingle: int = 5
    percent: int = 75
    broadcast_rows: int = 500_000


def words_of(text: Column) -> Column:
    """The words of a text: an empty array for null."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.filter(F.split(lowered, r"[ \t-\r]+"), lambda w: w != ""), F.array().cast("array<string>"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however the optimizer merges projections and filters."""
    return F.get(F.transform(F.array(value), use), 0)


def _hashes(words: Column, size: int) -> Column:
    long = F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.xxhash64(F.slice(words, i, size)))
    none = F.array().cast("array<bigint>")
    return F.when(F.size(words) >= size, long).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(none)


def shingle_hashes(df: DataFrame, text: str, out: str, size: int) -> DataFrame:
    """``df`` with the array ``out`` of the 64-bit hashes of the shingles of ``text``, repeats included."""
    return df.withColumn(out, bound(words_of(F.col(text)), lambda words: _hashes(words, size)))


def _limited(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def item_sketches(items: DataFrame, settings: ContainmentSettings) -> tuple[DataFrame, DataFrame]:
    """(item, set) of all items, and (item, value, part) with the sketch values and the size partition."""
    sets = shingle_hashes(items, "text", "all", settings.shingle).select("item", F.array_distinct("all").alias("set"))
    sets = sets.where(F.size("set") > 0)
    q = F.size("set")
    keep = (q - F.ceil(F.lit(settings.percent) * q / 100) + 1).cast("int")
    part = F.floor(F.log2(q)).cast("int")
    return sets, sets.select("item", part.alias("part"), F.explode(F.slice(F.sort_array("set"), 1, keep)).alias("value"))


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    settings: ContainmentSettings = ContainmentSettings(),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id, item, n_shared, n_item, containment) of every document and item with enough of its shingles."""
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    sets, sketches = item_sketches(items, settings)
    sketches = cut(sketches, "items-sketches")
    # One threshold for each size partition: there are as many as powers of two among the sizes of items.
    thresholds = {r["part"]: r["most"] for r in sketches.groupBy("part").agg(F.max("value").alias("most")).collect()}
    values = _limited(sketches.select("part", "value", "item").distinct(), settings.broadcast_rows)

    def of_part(hashes: Column, part: int, most: int) -> Column:
        return F.transform(F.filter(hashes, lambda v: v <= most), lambda v: F.struct(F.lit(part).alias("part"), v.alias("value")))

    def under(hashes: Column) -> Column:
        """(part, value) of the hash values that each partition looks at."""
        found = [of_part(hashes, part, most) for part, most in sorted(thresholds.items())]
        return F.concat(*found) if found else F.array().cast("array<struct<part:int,value:bigint>>")

    held = shingle_hashes(docs, "text", "all", settings.shingle).select("doc", F.explode(bound(F.col("all"), under)).alias("asked"))
    pairs = cut(held.select("doc", "asked.*").join(values, ["part", "value"]).select("doc", "item").distinct(), "items-pairs")

    ids = pairs.select("doc").distinct()
    few = _limited(ids, settings.broadcast_rows).withColumnRenamed("doc", "doc_")
    texts = docs.join(few, docs["doc"].eqNullSafe(few["doc_"]), "left_semi")
    full = shingle_hashes(texts, "text", "all", settings.shingle).select("doc", F.array_distinct("all").alias("all"))
    wanted = pairs.select(F.col("doc").alias("d"), F.col("item").alias("i"))
    if (sets.agg(F.sum(F.size("set"))).first()[0] or 0) <= 8 * settings.broadcast_rows:  # hashes, of which items have any number
        sets = F.broadcast(sets)
    both = full.join(wanted, full["doc"].eqNullSafe(wanted["d"])).join(sets, F.col("i").eqNullSafe(sets["item"]))
    both = both.select("doc", "item", F.size("set").alias("n_item"), F.size(F.array_intersect("all", "set")).alias("n_shared"))
    found = both.where(F.col("n_shared") * 100 >= settings.percent * F.col("n_item"))
    best = found.groupBy("doc", "item").agg(F.max(F.struct(F.col("n_shared") / F.col("n_item"), "n_shared", "n_item")).alias("b"))
    return best.select(
        F.col("doc").alias(id_col),
        F.col("item").alias(item_col),
        F.col("b.n_shared").cast("long").alias("n_shared"),
        F.col("b.n_item").cast("long").alias("n_item"),
        (F.col("b.n_shared") / F.col("b.n_item")).alias("containment"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, settings: ContainmentSettings = ContainmentSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id holds no item."""
    found = cut(contained_items(docs, items, settings, id_col, text_col).select(F.col(id_col).alias("doc_")).distinct(), "items-found")
    few = _limited(found, settings.broadcast_rows)
    return docs.join(few, docs[id_col].eqNullSafe(few["doc_"]), "left_anti")


ORACLE_SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda w: w <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda w: w <> '') FROM benchmark
), shingles AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS s
  FROM words
), items AS (SELECT id AS item_id, s, count(*) OVER (PARTITION BY id) AS n_item FROM shingles WHERE kind = 'i')
SELECT d.id AS doc_id, i.item_id, count(*) AS n_shared, i.n_item, count(*) / CAST(i.n_item AS DOUBLE) AS containment
FROM shingles d JOIN items i ON d.kind = 'd' AND d.s = i.s
GROUP BY d.id, i.item_id, i.n_item
HAVING count(*) * 100 >= 75 * i.n_item
"""
