"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and union-find grouping.

A document's set holds its distinct shingles of ``shingle`` words (ASCII white space separates words, A-Z is lower-cased; a
shorter document is one shingle). SuperMinHash gives slot p(j) of element e the value r(j) + j, where p is a random
permutation of the slots that belongs to e: the ranks within an element are correlated, which lowers the variance of the
estimate, and once every slot is below j no later rank can matter, so documents stop early.

Equal sets are one node. Bands of the signature propose pairs in passes, so that no bucket is expanded into all pairs:

1. every node of a bucket is paired with the bucket's smallest node; verified pairs give components;
2. nodes of buckets that still hold several components are compared on full sets, block by block within the clusters that
   such buckets tie together. Pairs are never rows: a task takes two bounded blocks and returns a spanning forest of the links
   it finds. Two nodes of one component need no test: their link is already there.

After both passes every pair of nodes that share a bucket is verified on full sets or lies within one component, whatever the
size of the bucket; nothing is capped.

Shingles are compared by 50-bit hashes: two different shingles of one pair of documents collide with probability near
n*n / 2**50.

Defined results: null texts and texts without words have an empty set and are linked with nothing; rows that share an id are
one node (linked by it); rows with a null id are linked with nothing and kept; very long texts are signed and compared whole, in
parts of bounded size; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smoothspan.llm.blockwise import block_count, overlaps
from smoothspan.llm.bytescan import blocks, mix, text_buffers, words
from smoothspan.llm.components import connected_components
from smoothspan.llm.scratch import consumed, cut
from smoothspan.llm.workers import returning_memory

HASH_BITS = 50


@dataclass(frozen=True)
class MinHashSettings:
    """Links need 100 * intersection >= ``percent`` * union. At 75 % the bands miss a pair with probability 5e-6.
    ``broadcast_rows``: most rows that are broadcast; larger tables are joined by a shuffle."""

    shingle: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    broadcast_rows: int = 500_000
    block_items: int = 65_536
    block_rows: int = 2048


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of a block of at most 2**14 rows, ordered by both."""
    value, _, row = words(raw, offsets)
    rows = len(offsets) - 1
    count = np.bincount(row, minlength=rows)
    first = np.append(0, np.cumsum(count))
    with np.errstate(over="ignore"):
        acc = np.zeros(max(len(value) - size + 1, 0), dtype=np.uint64)
        for k in range(size):
            acc = acc * np.uint64(0x100000001B3) + value[k : k + len(acc)]
        inside = np.flatnonzero(row[: len(acc)] == row[size - 1 : size - 1 + len(acc)]) if len(acc) else np.zeros(0, np.int64)
        shingles, owners = mix(acc[inside]), row[inside]
        short = np.flatnonzero((count > 0) & (count < size))
        if len(short):
            whole = np.zeros(len(short), dtype=np.uint64)
            for k in range(size - 1):
                has = count[short] > k
                whole[has] = whole[has] * np.uint64(0x100000001B3) + value[first[short[has]] + k] + np.uint64(1)
            whole = mix(whole + count[short].astype(np.uint64))
            shingles, owners = np.append(shingles, whole), np.append(owners, short)
    key = np.unique((owners.astype(np.uint64) << np.uint64(HASH_BITS)) | (shingles >> np.uint64(64 - HASH_BITS)))
    return (key >> np.uint64(HASH_BITS)).astype(np.int64), key & np.uint64((1 << HASH_BITS) - 1)


def super_minhash(owner: np.ndarray, item: np.ndarray, rows: int, slots: int, most_items: int = 1 << 17) -> np.ndarray:
    """Signatures (rows x slots) of the sets given as (owner, item); a value is rank * 2**32 + a 32-bit fraction.

    The signature of a set is the minimum over its parts, so at most ``most_items`` items are worked on at once."""
    out = np.full(rows * slots, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for start in range(0, len(item), most_items):
        _lower(out, owner[start : start + most_items], item[start : start + most_items], rows, slots)
    return out.reshape(rows, slots)


def _lower(out: np.ndarray, owner: np.ndarray, item: np.ndarray, rows: int, slots: int) -> None:
    """Lower the values in ``out`` by the ranks of some items."""
    drawn: list[np.ndarray] = []  # positions drawn so far, and what stood at the front before each draw
    front: list[np.ndarray] = []
    for j in range(slots):
        if not len(item):
            break
        with np.errstate(over="ignore"):
            random = mix(item * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j + 1))
        k = (j + ((random & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32))).astype(np.int16)
        at_front, position = np.full(len(item), j, np.int16), k.copy()
        for was, moved in zip(drawn, front, strict=True):  # a Fisher-Yates shuffle kept as its swaps
            hit = was == j
            at_front[hit] = moved[hit]
            hit = was == k
            position[hit] = moved[hit]
        value = (np.uint64(j) << np.uint64(32)) | (random >> np.uint64(32))
        np.minimum.at(out, owner * slots + position, value)
        open_rows = (out.reshape(rows, slots) >= (np.uint64(j + 1) << np.uint64(32))).any(axis=1)
        keep = open_rows[owner]
        drawn.append(k)
        front.append(at_front)
        if not keep.all():
            owner, item = owner[keep], item[keep]
            drawn, front = [x[keep] for x in drawn], [x[keep] for x in front]


def sign_column(column: pa.Array, settings: MinHashSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set size, two set hashes, band hashes) of every row."""
    raw, offsets = text_buffers(column)
    n = len(offsets) - 1
    sizes, low, high = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    bands = np.zeros((n, settings.bands), np.uint64)
    for first, rows, part, at in blocks(raw, offsets):
        owner, item = shingle_sets(part, at, settings.shingle)
        part_rows = slice(first, first + rows)
        sizes[part_rows] = np.bincount(owner, minlength=rows)
        with np.errstate(over="ignore"):
            np.add.at(low[part_rows], owner, mix(item))
            np.add.at(high[part_rows], owner, mix(item ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
            signature = super_minhash(owner, item, rows, settings.bands * settings.rows)
            for b in range(settings.bands):
                acc = np.full(rows, b + 1, np.uint64)
                for k in range(settings.rows):
                    acc = mix(acc * np.uint64(0x100000001B3) + signature[:, b * settings.rows + k])
                bands[part_rows, b] = acc
    return sizes, low.view(np.int64), high.view(np.int64), bands.view(np.int64)


def _list(values: np.ndarray, width: int) -> pa.Array:
    offsets = pa.array(np.arange(0, len(values) * width + 1, width, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1)))


def signatures(docs: DataFrame, settings: MinHashSettings, id_col: str, text_col: str) -> DataFrame:
    """(node, n_shingles, low, high, bands) of every row."""

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, low, high, bands = sign_column(batch.column(1), settings)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(low), pa.array(high), _list(bands, settings.bands)],
                names=["node", "n_shingles", "low", "high", "bands"],
            )

    source = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col))
    return source.mapInArrow(run, "node long, n_shingles long, low long, high long, bands array<long>")


def shingles_of(docs: DataFrame, settings: MinHashSettings) -> DataFrame:
    """(node, items): the full set of every row of (node, text)."""

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for first, rows, part, at in blocks(raw, offsets):
                owner, item = shingle_sets(part, at, settings.shingle)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)), pa.array(item.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), lists], names=["node", "items"])

    return docs.select("node", "text").mapInArrow(run, "node long, items array<long>")


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it was counted to have at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def jaccard_at_least(percent: int, a: str, b: str) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both * 100 >= percent * (F.size(a) + F.size(b) - both)


def _verify(pairs: DataFrame, docs: DataFrame, settings: MinHashSettings) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. ``docs``: (node, text), one row for each node."""
    pairs = cut(pairs.distinct(), "minhash-pairs")
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "minhash-wanted")
    sets = cut(shingles_of(docs.join(small_side(wanted, settings.broadcast_rows), "node", "left_semi"), settings), "minhash-sets")
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    return cut(both.where(jaccard_at_least(settings.percent, "x", "y")).select("a", "b"), "minhash-links")


def _named(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, node, component) of the members of buckets."""
    joined = members.join(labels, "node", "left")
    return cut(joined.select("band", "node", F.coalesce("component", "node").alias("component")), "minhash-named")


def _link_clusters(mixed: DataFrame, docs: DataFrame, settings: MinHashSettings) -> DataFrame:
    """Links (a, b) between different components of the nodes (node, component, centre) that share mixed buckets.

    Nodes tied by buckets are a cluster. Its nodes are dealt to blocks of about ``block_items`` shingles, and each pair of
    blocks is compared by one task on full sets. A task returns the edges of a spanning forest, not all linked pairs.
    """
    ties = connected_components(mixed, "node", "centre", "minhash-clusters").select("node", F.col("component").alias("cluster"))
    nodes = mixed.select("node", "component").distinct().join(ties, "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    nodes = cut(nodes, "minhash-nodes")
    sets = cut(shingles_of(docs.join(small_side(nodes.select("node"), settings.broadcast_rows), "node", "left_semi"), settings), "minhash-sets")
    held = nodes.join(sets, "node")
    size = held.groupBy("cluster").agg(block_count("items", settings.block_items, settings.block_rows).alias("blocks"))
    dealt = held.join(size, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "items")
    # A number of partitions of its own: groups are few bytes and much work, so they must not be coalesced.
    each = each.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cluster", "i", "j")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, component = table["node"].to_numpy(), table["component"].to_numpy()
        # Rows of the first block against all rows; both blocks are one if i = j.
        first = np.flatnonzero(table["block"].to_numpy() == table["i"].to_numpy())
        parent: dict[int, int] = {}
        edges = []

        def find(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for part, both, union in overlaps(table["items"].combine_chunks(), first):
            linked = (both * 100 >= settings.percent * union) & (component[part][:, None] != component[None, :])
            # One link for each pair of components: the others add nothing.
            k, m = np.nonzero(linked)
            _, once = np.unique(np.stack([component[part[k]], component[m]]), axis=1, return_index=True)
            for a, b in zip(part[k[once]].tolist(), m[once].tolist(), strict=True):
                ra, rb = find(int(component[a])), find(int(component[b]))
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
                    edges.append((max(int(node[a]), int(node[b])), min(int(node[a]), int(node[b]))))
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return cut(each.groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long"), "minhash-cluster-links")


def near_duplicates(docs: DataFrame, settings: MinHashSettings = MinHashSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, n_shingles, component_id) of every row; component_id is the smallest id reachable over links."""
    with consumed(docs.sparkSession) as keep:
        return keep(_grouped(docs, settings, id_col, text_col), "minhash-result")


def _grouped(docs: DataFrame, settings: MinHashSettings, id_col: str, text_col: str) -> DataFrame:
    signed = cut(signatures(docs, settings, id_col, text_col), "minhash-signed")
    sets = signed.where("n_shingles > 0 and node is not null").groupBy("low", "high", "n_shingles").agg(F.min("node").alias("first"))
    sets = cut(sets, "minhash-classes")
    rows = signed.select("node", "n_shingles", "low", "high")
    same = rows.join(sets, ["low", "high", "n_shingles"]).where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    # Only a set's first row is searched; ids that several rows share are one node.
    heads = sets.select("low", "high", "n_shingles", F.col("first").alias("node"))
    head_rows = signed.join(heads, ["low", "high", "n_shingles", "node"], "left_semi")
    bands = head_rows.select("node", F.explode(F.array_distinct("bands")).alias("band"))
    buckets = bands.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("band", "least")
    members = cut(bands.join(buckets, "band"), "minhash-buckets")  # (band, node, least)

    source = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    stars = members.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    tested = cut(stars.distinct(), "minhash-stars")
    links = _verify(tested, source, settings)
    named = _named(members, connected_components(links, "a", "b", "minhash-labels"))
    spread = named.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("centre"))
    mixed = cut(named.join(spread.where("low < high").select("band", "centre"), "band").drop("band").distinct(), "minhash-mixed")
    if not mixed.isEmpty():
        links = links.unionByName(_link_clusters(mixed, source, settings))
    groups = connected_components(links.unionByName(same), "a", "b", "minhash-groups")
    out = rows.join(groups.select("node", "component"), "node", "left")
    return out.select("node", "n_shingles", F.coalesce("component", "node").alias("component_id"))


def keep_one_of_each(docs: DataFrame, settings: MinHashSettings = MinHashSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group; rows with a null id stay."""
    groups = near_duplicates(docs, settings, id_col, text_col).where("node <> component_id").select(F.col("node").alias("node_")).distinct()
    gone = small_side(cut(groups, "minhash-gone"), settings.broadcast_rows)
    return docs.join(gone, docs[id_col] == gone["node_"], "left_anti")


#: The contract of op8 in SQL: exact sets and links, smallest reachable id.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda w: w <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS s
  FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.b, r.root FROM reach r JOIN edges e ON r.node = e.a WHERE r.root < e.b
), least AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.root AS component_id, d.doc_id = l.root AS kept
FROM documents d JOIN least l ON l.node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""
