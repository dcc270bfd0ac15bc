"""Near-duplicate lines by an exact set-similarity join, and their removal.

A line is the set of its ``shingle``-word shingles (ASCII white space separates words, A-Z is lower-cased). Two lines match if
the Jaccard similarity of their sets is at least ``percent`` / 100. A line is removed if any earlier line, in the order of
(document id, line number), matches it. With ``short_lines`` a line of fewer than ``shingle`` words has one token, its whole word
sequence, and so matches equal ones; without, such lines are never matched.

The join: the tokens (shingles) of a line are ordered by rarity: by classes of their count in all documents (once, less than 8
times, less than 32, and so on by powers of four), ties by hash, so the order is the same everywhere and the join is exact. A line is indexed under its prefix, the
n - ceil(t * n) + 1 rarest of its n tokens; matching lines share a prefix token, and a token that was seen once is shared by no
line, so it is not indexed; nor is the token of a line that has only one, whose matches are all of its class. Lines whose whole
prefix was seen once match nothing and leave the join at once.

How often a token was seen is counted by slices of the tokens: every task sends the first bits of its tokens as sorted,
compressed runs with their counts (about two bytes a token), a slice is counted by one task, and slices and bits grow with the
text. The tokens of each class and of the more common ones fill a filter of fixed size that every task holds, a quarter of the
size from class to class; what a filter holds wrongly makes a token seem more common to every task alike, which costs time and
no result. Beyond some 10^8 distinct shared tokens the first filter lets most tokens pass, and all prefixes are shuffled. Pairs must pass the length filter,
the positional filter (tokens left after the shared one on both sides) and a 64-bit sketch of the sets that bounds their
difference, all of which only drop pairs that cannot match; the rest is verified on full sets.

Equal sets are one class, and only first occurrences are joined. Short lists of a token are joined with themselves. In long
ones each class is compared with the first class of the list; as only the existence of an earlier match matters, classes
found to have one are not searched for again. Classes of long lists that have none yet are compared on full sets block by
block within the clusters that their lists tie together: pairs are never rows, whatever the size of a group of near copies.

Tokens are compared by 64-bit hashes and classes by 128-bit hashes of their tokens.

Defined results: null texts stay null and empty ones empty; lines are split at ``\\n`` only; a document whose lines all go
keeps an empty text; rows that share an id are one document, of which lines with one number are one line and go or stay
together; rows with a null id come first in the order and are one document too; very long lines and texts are compared whole;
of equal lines the first one in the order stays; an empty table gives an empty one. Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smoothspan.llm.blockwise import block_count, overlaps
from smoothspan.llm.bytescan import blocks, mix, text_buffers, words
from smoothspan.llm.components import connected_components
from smoothspan.llm.scratch import consumed, cut
from smoothspan.llm.workers import returning_memory

@dataclass(frozen=True)
class LineSettings:
    """``short_lines``: whether lines of fewer than ``shingle`` words take part, by their whole word sequence.
    ``short_list``: lists up to this length are joined with themselves, longer ones in two passes (the result is the same).
    ``filter_bits``: the filter of shared tokens that every task holds has two to this power bits; those of more common tokens
    have a third of that together. ``slice_bytes``: bytes of text for each slice of
    the tokens that one task counts. ``run_tokens``: tokens that a scanning task sorts at once.
    ``broadcast_rows``: most rows that are broadcast; larger tables are joined by a shuffle."""

    percent: int = 75
    shingle: int = 5
    short_lines: bool = False
    short_list: int = 64
    block_items: int = 16_384
    block_rows: int = 2048
    filter_bits: int = 28
    slice_bytes: int = 32 << 20
    run_tokens: int = 1 << 20
    broadcast_rows: int = 500_000


def _line_sets(raw: np.ndarray, offsets: np.ndarray, size: int, short_lines: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, token) of the distinct tokens of each line that has some, ordered by line; then row and number of every line."""
    value, start, row = words(raw, offsets)
    breaks = np.flatnonzero(raw == 10)
    at = np.searchsorted(breaks, start) + row  # rows end lines too
    acc = np.zeros(max(len(value) - size + 1, 0), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            acc = acc * np.uint64(0x100000001B3) + value[k : k + len(acc)]
        inside = np.flatnonzero(at[: len(acc)] == at[size - 1 : size - 1 + len(acc)]) if len(acc) else np.zeros(0, np.int64)
        token, line = mix(acc[inside]), at[inside]
        if short_lines and len(at):
            first = _starts(at)
            length = np.diff(np.append(first, len(at)))
            first, length = first[length < size], length[length < size]
            acc = np.zeros(len(first), dtype=np.uint64)
            for k in range(size - 1):
                more = length > k
                acc[more] = acc[more] * np.uint64(0x100000001B3) + value[first[more] + k]
            line = np.concatenate([line, at[first]])
            order = np.argsort(line, kind="stable")
            token, line = np.concatenate([token, mix(acc)])[order], line[order]
    # Repeats within a line are rare: only lines that may have some are looked at closer.
    key = np.sort((token << np.uint64(_LINE_BITS)) | (line.astype(np.uint64) & np.uint64((1 << _LINE_BITS) - 1)))
    same = key[1:][key[1:] == key[:-1]]
    if len(same):
        some = np.zeros(1 << _LINE_BITS, bool)
        some[(same & np.uint64((1 << _LINE_BITS) - 1)).astype(np.int64)] = True
        look = np.flatnonzero(some[line & ((1 << _LINE_BITS) - 1)])
        order = look[np.lexsort((token[look], line[look]))]
        again = (token[order][1:] == token[order][:-1]) & (line[order][1:] == line[order][:-1])
        keep = np.ones(len(token), bool)
        keep[order[1:][again]] = False
        token, line = token[keep], line[keep]
    per_row = np.searchsorted(breaks, offsets[:-1])  # line breaks before each row
    first_line = per_row + np.arange(len(offsets) - 1)
    count = np.diff(np.append(first_line, len(breaks) + len(offsets) - 1))
    owner = np.repeat(np.arange(len(offsets) - 1), count)
    number = np.arange(len(owner)) - np.repeat(first_line, count)
    return line, token, owner, number


_LINE_BITS = 16


def _starts(line: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, np.int64)


def _class_hashes(token: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        low = np.add.reduceat(mix(token), starts)
        high = np.add.reduceat(mix(token ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
    return low.view(np.int64), high.view(np.int64)


def _pack(slots: np.ndarray) -> bytes:
    """Ascending numbers as compressed differences, one plane for each byte of them."""
    step = np.diff(slots, prepend=np.uint64(0))
    planes = step.astype("<u8").view(np.uint8).reshape(-1, 8)
    used = int(step.max()).bit_length() + 7 >> 3 if len(step) else 0
    return bytes([used]) + zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(planes[:, :used].T).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    used = data[0]
    if not used:  # no number, or the number 0 alone, which is told apart by the caller
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(used, -1)
    step = np.zeros((planes.shape[1], 8), np.uint8)
    step[:, :used] = planes.T
    return np.cumsum(step.view("<u8").reshape(-1), dtype=np.uint64)


@dataclass(frozen=True)
class TokenClasses:
    """Filters of the tokens by how often they were seen: filter k holds all tokens seen 2 * 4**k times or more, and few others.
    Every slice of the tokens (by their first bits) has its own part of each filter."""

    filters: list[np.ndarray]
    slot_bits: int
    slice_bits: int

    @staticmethod
    def part_bits(settings: LineSettings, slice_bits: int) -> list[int]:
        """Bits of a slice's part of each filter: a quarter of the tokens at most are seen four times as often."""
        return list(range(settings.filter_bits - slice_bits, 2, -2))

    @staticmethod
    def places(slot: np.ndarray, part_bits: int) -> tuple[np.ndarray, np.ndarray]:
        spread, most = mix(slot), np.uint64((1 << part_bits) - 1)
        return spread & most, (spread >> np.uint64(32)) & most

    def of(self, token: np.ndarray) -> np.ndarray:
        """The class of each token: 0 if it was seen once, more for more common ones."""
        found = np.zeros(len(token), np.int8)
        left = np.arange(len(token))
        for table in self.filters:
            slot = token[left] >> np.uint64(64 - self.slot_bits)
            bits = len(table).bit_length() + 2 - self.slice_bits
            base = (token[left] >> np.uint64(64 - self.slice_bits)) << np.uint64(bits)
            held = np.ones(len(left), bool)
            for place in self.places(slot, bits):
                place = base | place
                held &= (table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
            left = left[held]
            if not len(left):
                break
            found[left] += 1
        return found


def count_classes(docs: DataFrame, settings: LineSettings) -> TokenClasses:
    """The classes of the tokens by their number of occurrences in all documents.

    A task sends the first bits of its tokens as sorted runs with counts, cut into slices; a slice is counted by one task, which
    returns its part of the filters. Bits and slices grow with the text, so that tokens rarely meet and a slice stays of one
    size; the filters themselves have a fixed size."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slice_bits = min(settings.filter_bits - 10, max(5, (total // settings.slice_bytes).bit_length()))
    slot_bits = min(48, max(30, total.bit_length() + 4))
    part_bits = TokenClasses.part_bits(settings, slice_bits)

    @returning_memory
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = np.arange(1 << slice_bits, dtype=np.uint64) << np.uint64(slot_bits - slice_bits)

        def run(held: list[np.ndarray]) -> pa.RecordBatch:
            slots = np.sort(np.concatenate(held))
            new = np.append(True, slots[1:] != slots[:-1])
            again, more = np.unique(slots[~new], return_counts=True)  # occurrences but the first
            slots, more = slots[new], more.astype("<u4")
            cuts, ends = (np.append(np.searchsorted(x, heads), len(x)) for x in (slots, again))
            rows = [k for k in range(len(heads)) if cuts[k] < cuts[k + 1]]
            one = np.uint64(1)  # so that no run is the number 0 alone
            pack = zstandard.ZstdCompressor(1).compress
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(rows, pa.int32()),
                    pa.array([_pack(slots[cuts[k] : cuts[k + 1]] - heads[k] + one) for k in rows], pa.binary()),
                    pa.array([_pack(again[ends[k] : ends[k + 1]] - heads[k] + one) for k in rows], pa.binary()),
                    pa.array([pack(more[ends[k] : ends[k + 1]].tobytes()) for k in rows], pa.binary()),
                ],
                names=["slice", "seen", "again", "more"],
            )

        held: list[np.ndarray] = []
        for batch in batches:
            raw, offsets = text_buffers(batch.column(0))
            for _, _, part, at in blocks(raw, offsets):
                _, token, _, _ = _line_sets(part, at, settings.shingle, settings.short_lines)
                held.append(token >> np.uint64(64 - slot_bits))
                if sum(map(len, held)) >= settings.run_tokens:
                    yield run(held)
                    held = []
        if sum(map(len, held)):
            yield run(held)

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, again, more = [], [], []
        for batch in batches:
            seen += [_unpack(x.as_py()) for x in batch.column(1)]
            again += [_unpack(x.as_py()) for x in batch.column(2)]
            more += [np.frombuffer(zstandard.decompress(x.as_py()), "<u4") for x in batch.column(3)]
        slots = np.concatenate(seen)
        del seen
        slots.sort()
        same = slots[1:][slots[1:] == slots[:-1]]
        # Only tokens seen more often are counted, so that little is held beside the slots.
        slots, which = np.unique(np.concatenate([same, *again]), return_inverse=True)
        count = 1 + np.bincount(which, np.concatenate([np.ones(len(same)), *more]), len(slots))
        head = np.uint64(key[0].as_py()) << np.uint64(slot_bits - slice_bits)
        packed = []
        for k, wide in enumerate(part_bits):
            bits = np.zeros(1 << wide, bool)
            for place in TokenClasses.places(slots[count >= 2 * 4**k] + head - np.uint64(1), wide):
                bits[place.astype(np.int64)] = True
            packed.append(zstandard.ZstdCompressor(1).compress(np.packbits(bits, bitorder="little").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([packed], pa.list_(pa.binary()))], names=["slice", "bits"])

    marked = docs.select("text").mapInArrow(mark, "slice int, seen binary, again binary, more binary")
    filters = [np.zeros((1 << wide + slice_bits) // 8, np.uint8) for wide in part_bits]
    for row in marked.groupBy("slice").applyInArrow(merge, "slice int, bits array<binary>").collect():  # filters of fixed size
        for table, packed in zip(filters, row["bits"]):
            part = np.frombuffer(zstandard.decompress(packed), np.uint8)
            table[row["slice"] * len(part) : (row["slice"] + 1) * len(part)] = part
    return TokenClasses(filters, slot_bits, slice_bits)


def index_lines(docs: DataFrame, classes: TokenClasses, settings: LineSettings) -> DataFrame:
    """(doc, line, low, high, size, alone, sketch, prefix) of every line that may match another; prefix: (word, place) of its
    rarest tokens without those seen once; alone: some token was seen once, so that no other line is equal."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for first, rows, part, at in blocks(raw, offsets):
                line, token, owner, number = _line_sets(part, at, settings.shingle, settings.short_lines)
                if not len(line):
                    continue
                starts = _starts(line)
                size = np.diff(np.append(starts, len(line)))
                rarity = held.of(token)
                often = rarity > 0
                unique = size - np.add.reduceat(often, starts, dtype=np.int64)
                prefix = size - -(-settings.percent * size // 100) + 1
                # Lines with a whole prefix of tokens seen once match nothing.
                stays = np.flatnonzero((unique == 0) | ((unique < prefix) & (unique < size)))
                index = np.repeat(np.arange(len(stays)), size[stays])
                places = np.repeat(starts[stays] - np.append(0, np.cumsum(size[stays]))[:-1], size[stays]) + np.arange(len(index))
                token, rarity, which = token[places], rarity[places], line[starts[stays]]
                size, unique, prefix = size[stays], unique[stays], prefix[stays]
                if not len(stays):
                    continue
                low, high = _class_hashes(token, np.append(0, np.cumsum(size))[:-1])
                sketch = np.bitwise_or.reduceat(np.uint64(1) << (mix(token) >> np.uint64(58)), np.append(0, np.cumsum(size))[:-1]).view(np.int64)
                # Tokens seen once fill the first places; of the others, by class and hash, those that still fall into the prefix.
                kept = np.flatnonzero(rarity)
                order = kept[np.lexsort((token[kept], rarity[kept], index[kept]))]
                index = index[order]
                count = np.bincount(index, minlength=len(stays))
                position = np.arange(len(order)) - np.repeat(np.append(0, np.cumsum(count))[:-1], count) + unique[index]
                chosen = (position < prefix[index]) & ((size[index] > 1) | (settings.percent <= 50))
                ends = np.append(0, np.cumsum(np.bincount(index[chosen], minlength=len(stays)))).astype(np.int32)
                entries = pa.StructArray.from_arrays(
                    [pa.array(token[order][chosen].view(np.int64)), pa.array(position[chosen].astype(np.int32))], names=["word", "place"]
                )
                ids = batch.column(0).slice(first, rows).take(pa.array(owner[which]))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(number[which].astype(np.int32)),
                        pa.array(low),
                        pa.array(high),
                        pa.array(size.astype(np.int32)),
                        pa.array(unique > 0),
                        pa.array(sketch, mask=np.diff(ends) == 0),
                        pa.ListArray.from_arrays(pa.array(ends), entries),
                    ],
                    names=["doc", "line", "low", "high", "size", "alone", "sketch", "prefix"],
                )

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.select("doc", "text").mapInArrow(
        run, f"doc {kind}, line int, low long, high long, size int, alone boolean, sketch long, prefix array<struct<word: bigint, place: int>>"
    )


def _full_sets(docs: DataFrame, wanted: DataFrame, settings: LineSettings) -> DataFrame:
    """(doc, line, low, high, items) of the wanted classes (low, high, doc, line), taken from the texts of their first lines."""
    ids = cut(wanted.select("doc").distinct(), "lines-wanted")
    few = F.broadcast(ids) if ids.count() <= settings.broadcast_rows else ids

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for first, rows, part, at in blocks(raw, offsets):
                line, token, owner, number = _line_sets(part, at, settings.shingle, settings.short_lines)
                if not len(line):
                    continue
                starts = _starts(line)
                low, high = _class_hashes(token, starts)
                which = line[starts]
                items = pa.ListArray.from_arrays(pa.array(np.append(starts, len(line)).astype(np.int32)), pa.array(token.view(np.int64)))
                ids = batch.column(0).slice(first, rows).take(pa.array(owner[which]))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(number[which].astype(np.int32)), pa.array(low), pa.array(high), items], names=["doc", "line", "low", "high", "items"]
                )

    kind = docs.schema["doc"].dataType.simpleString()
    texts = docs.join(few, docs["doc"].eqNullSafe(few["doc"]), "left_semi").select("doc", "text")
    lines = texts.mapInArrow(run, f"doc {kind}, line int, low long, high long, items array<long>")
    keys = wanted.select(F.col("low").alias("l"), F.col("high").alias("h"), F.col("doc").alias("d"), F.col("line").alias("n"))
    if keys.count() <= settings.broadcast_rows:  # else the sets of all lines of these documents are shuffled
        keys = F.broadcast(keys)
    on = (lines["low"] == keys["l"]) & (lines["high"] == keys["h"]) & lines["doc"].eqNullSafe(keys["d"]) & (lines["line"] == keys["n"])
    return lines.join(keys, on, "left_semi")


def _may_match(percent: int) -> Column:
    """Length, positional and sketch filters between postings with the prefixes x_ and y_."""
    x, y = F.col("x_size"), F.col("y_size")
    need = F.ceil(F.lit(percent) * (x + y) / (100 + percent)).cast("int")  # least intersection
    length = (x * 100 >= y * percent) & (y * 100 >= x * percent)
    position = F.least("x_place", "y_place") + F.least(x - F.col("x_place"), y - F.col("y_place")) >= need
    differ = F.bit_count(F.col("x_sketch").bitwiseXOR(F.col("y_sketch")))
    return length & (differ <= x + y - 2 * need) & position


def _sets_of(keys: DataFrame, docs: DataFrame, classes: DataFrame, settings: LineSettings) -> DataFrame:
    """(low, high, place, items) of the classes with the given hashes ``low``; place is a class's first line."""
    wanted = cut(classes.join(keys, "low", "left_semi").select("low", "high", "doc", "line"), "lines-keys")
    return cut(_full_sets(docs, wanted, settings).select("low", "high", F.struct("doc", "line").alias("place"), "items"), "lines-sets")


def _later_of_matches(pairs: DataFrame, docs: DataFrame, classes: DataFrame, settings: LineSettings) -> DataFrame:
    """(low, high) of the later class of each pair (x, y) of class hashes whose full sets match."""
    sets = _sets_of(pairs.select(F.explode(F.array("x", "y")).alias("low")).distinct(), docs, classes, settings)
    left, right = (sets.select(*[F.col(c).alias(f"{p}_{c}") for c in sets.columns]) for p in "xy")
    both = pairs.join(left, F.col("x") == F.col("x_low")).join(right, F.col("y") == F.col("y_low"))
    common = F.size(F.array_intersect("x_items", "y_items"))
    match = common * 100 >= settings.percent * (F.size("x_items") + F.size("y_items") - common)
    first = F.col("x_place") < F.col("y_place")
    later = both.where(match).select(F.when(first, F.col("y_low")).otherwise(F.col("x_low")).alias("low"), F.when(first, F.col("y_high")).otherwise(F.col("x_high")).alias("high"))
    return cut(later.distinct(), "lines-later")


def _later_in_clusters(ties: DataFrame, found: DataFrame, docs: DataFrame, classes: DataFrame, settings: LineSettings) -> DataFrame:
    """(low, high) of classes in ``ties`` (cid, centre) that are not found yet and have an earlier match in their cluster."""
    labels = connected_components(ties, "cid", "centre", "lines-clusters")
    nodes = ties.select(F.explode(F.array("cid", "centre")).alias("node")).distinct().join(labels, "node", "left")
    nodes = cut(nodes.select(F.col("node").alias("low"), F.coalesce("component", "node").alias("cluster")), "lines-nodes")
    sets = _sets_of(nodes.select("low"), docs, classes, settings).select("low", "high", "place.doc", "place.line", "items")
    held = sets.join(nodes, "low").join(found.withColumn("found", F.lit(True)), ["low", "high"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    size = held.groupBy("cluster").agg(block_count("items", settings.block_items, settings.block_rows).alias("blocks"))
    dealt = held.join(size, "cluster").withColumn("block", F.pmod(F.xxhash64("low", "high"), F.col("blocks")).cast("int"))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "low", "high", "doc", "line", "found", "items")
    # A number of partitions of its own: groups are few bytes and much work, so they must not be coalesced.
    each = each.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cluster", "i", "j")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc", "ascending"), ("line", "ascending")]).combine_chunks()
        null = table["doc"].is_null().to_numpy()  # nulls come first in the order
        order = np.argsort(~null, kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        first = np.flatnonzero(table["block"].to_numpy() == table["i"].to_numpy())
        rank = np.arange(len(table))
        later = np.zeros(len(table), bool)
        for part, both, union in overlaps(table["items"].combine_chunks(), first):
            match = both * 100 >= settings.percent * union
            later[part] |= (match & (rank[None, :] < part[:, None])).any(axis=1)
            later |= (match & (rank[None, :] > part[:, None])).any(axis=0)
        out = np.flatnonzero(later & ~table["found"].to_numpy())
        return table.select(["low", "high"]).take(pa.array(out))

    return cut(each.groupBy("cluster", "i", "j").applyInArrow(compare, "low long, high long").distinct(), "lines-later")


def duplicate_lines(docs: DataFrame, settings: LineSettings = LineSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, line) of every line that an earlier line matches; doc is the id column's value and lines count from 0."""
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    lines = cut(index_lines(docs, count_classes(docs, settings), settings), "lines-index")
    key = ["low", "high"]
    head = F.min(F.struct("doc", "line", "size", "sketch", "prefix")).alias("head")
    same = lines.where("not alone").groupBy(*key).agg(head, F.count("*").alias("n")).select(*key, "head.*", "n")
    single = lines.where("alone").select(*key, "doc", "line", "size", "sketch", "prefix", F.lit(1).cast("long").alias("n"))
    heads = cut(same.unionByName(single), "lines-classes")
    classes = heads.select(*key, "doc", "line", "n")
    postings = heads.where(F.size("prefix") > 0).select(F.col("low").alias("cid"), "size", "sketch", "doc", "line", F.explode("prefix").alias("p"))
    postings = postings.select("p.word", "cid", "size", F.col("p.place").alias("place"), "sketch", "doc", "line")
    lists = postings.groupBy("word").agg(F.count("*").alias("list")).where("list > 1")
    postings = cut(postings.join(lists, "word"), "lines-postings")
    short, long = postings.where(F.col("list") <= settings.short_list), postings.where(F.col("list") > settings.short_list)

    def named(df: DataFrame, prefix: str) -> DataFrame:
        return df.select("word", *[F.col(c).alias(f"{prefix}_{c}") for c in ("cid", "size", "place", "sketch")])

    pair = (F.least("x_cid", "y_cid").alias("x"), F.greatest("x_cid", "y_cid").alias("y"))
    may = _may_match(settings.percent)
    close = named(short, "x").join(named(short, "y"), "word").where((F.col("x_cid") < F.col("y_cid")) & may).select(*pair)
    firsts = long.groupBy("word").agg(F.min(F.struct("doc", "line", "cid", "size", "sketch", "place")).alias("s")).select("word", "s.*")
    stars = named(long, "x").join(named(firsts, "y"), "word").where((F.col("x_cid") != F.col("y_cid")) & may).select(*pair)
    tested = cut(close.union(stars).distinct(), "lines-pairs")
    found = _later_of_matches(tested, docs, classes, settings)

    centres = firsts.select("word", F.col("cid").alias("centre"))
    open_ = long.select("word", "cid").join(found.select(F.col("low").alias("cid")), "cid", "left_anti").join(centres, "word").where("cid <> centre")
    busy = long.select("word", "cid").join(open_.select("word").distinct(), "word", "left_semi").join(centres, "word")
    ties = cut(busy.select("cid", "centre").distinct(), "lines-ties")
    if not ties.isEmpty():
        found = found.union(_later_in_clusters(ties, found, docs, classes, settings)).distinct()

    # Later lines of a class go, and the first one if an earlier class matches. The few classes with a large share of the
    # lines (2,000 at most) are told to every task, so that no task gets all lines of such a class.
    hit = classes.join(found.withColumn("matched", F.lit(True)), key, "left").where("n > 1 or matched")
    hit = cut(hit.select(*key, "n", F.col("doc").alias("d"), F.col("line").alias("k"), F.coalesce("matched", F.lit(False)).alias("matched")), "lines-hit")
    members = lines.select("doc", "line", *key)
    large = F.col("n") > max(1000, lines.count() // 2000)
    told = F.broadcast(hit.where(large))
    gone = members.join(told, key).unionByName(members.join(told.select(*key), key, "left_anti").join(hit.where(~large), key))
    return gone.where("matched or not (doc <=> d and line <=> k)").select("doc", "line")


def drop_duplicate_lines(
    docs: DataFrame, settings: LineSettings = LineSettings(), id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False
) -> DataFrame:
    """``docs``, with all its columns, without the lines of :func:`duplicate_lines`.

    With ``drop_emptied``, documents of which nothing but white space is left by the removal go too; texts that were empty stay.
    """
    found = _without(docs, settings, id_col, text_col)
    if drop_emptied:
        found = found.where(~((F.col("n_removed") > 0) & F.coalesce(F.col("kept_text").rlike(r"^\s*$"), F.lit(False))))
    return found.select(*[F.col("kept_text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def _without(docs: DataFrame, settings: LineSettings, id_col: str, text_col: str) -> DataFrame:
    """(row, kept_text, n_lines, n_removed): the rows of ``docs`` as structs, so that no column of theirs clashes with others."""
    with consumed(docs.sparkSession) as keep:
        gone = duplicate_lines(docs, settings, id_col, text_col)
        lists = keep(gone.groupBy("doc").agg(F.sort_array(F.collect_set("line")).alias("lines")), "lines-gone")  # lines of one document
    size = lists.agg(F.sum(F.size("lines"))).first()[0] or 0
    side = F.broadcast(lists) if size <= 4 * settings.broadcast_rows else lists
    base = docs.select(docs[id_col].alias("id"), docs[text_col].alias("whole"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    parts = F.split("whole", "\n")
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col("lines"), i)), "\n")
    joined = base.join(side, base["id"].eqNullSafe(side["doc"]), "left")
    return joined.select(
        "row",
        F.when(F.col("lines").isNull(), F.col("whole")).otherwise(kept).alias("kept_text"),
        F.when(F.col("whole").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"),
    )


def line_report(docs: DataFrame, settings: LineSettings = LineSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_removed, text): every document with its lines counted and the text that is left."""
    found = _without(docs.select(id_col, text_col), settings, id_col, text_col)
    return found.select(F.col("row").getField(id_col).alias(id_col), "n_lines", "n_removed", F.col("kept_text").alias(text_col))


#: op3 in SQL: a line goes if an earlier one has enough of the same shingles, or the same few words.
ORACLE_SQL = r"""
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, k - 1 AS line, l[k] AS t FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM parts)),
words AS (
  SELECT doc_id, line, list_filter(regexp_split_to_array(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda w: w <> '') AS w
  FROM lines
), tokens AS (
  SELECT DISTINCT doc_id, line, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS s
  FROM words
), sizes AS (SELECT doc_id, line, count(*) AS n FROM tokens GROUP BY 1, 2),
pairs AS (
  SELECT a.doc_id AS d, a.line AS k, b.doc_id AS doc_id, b.line AS line, count(*) AS shared
  FROM tokens a JOIN tokens b ON a.s = b.s AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.line < b.line)) GROUP BY 1, 2, 3, 4
), gone AS (
  SELECT DISTINCT p.doc_id, p.line
  FROM pairs p JOIN sizes x ON x.doc_id = p.d AND x.line = p.k JOIN sizes y ON y.doc_id = p.doc_id AND y.line = p.line
  WHERE 100 * shared >= 75 * (x.n + y.n - shared)
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.line) AS n_removed, coalesce(string_agg(l.t, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, k.text FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
