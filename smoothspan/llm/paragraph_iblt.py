"""Document fingerprints that can be subtracted: invertible Bloom lookup tables of paragraph digests.

A text is cut into paragraphs at line breaks, a long paragraph into pieces of ``piece_words`` words, and each distinct piece
gets a 64-bit digest. A fingerprint is a table of cells (count, xor of digests, xor of check hashes) in three parts; a digest is
entered once in each part. Its size goes with the difference that is expected between versions (``share`` of the digests), so
it holds fewer cells than would list all digests. Subtracting the cells of two fingerprints leaves the digests in which the
texts differ; peeling (take a cell with one digest, remove it from its other cells, repeat) recovers them with their side.
Sizes are powers of two, and the larger of two tables is folded to the size of the smaller one first.

Where peeling gets stuck, because the texts differ in more than expected or by chance, both tables are built again, large
enough for all digests of both texts and with other positions, twice as large at each of ``retries`` times. If that fails too,
the two lists of digests are compared; the number of retries is returned, so no estimate is ever passed off as a result.

The likeness of two texts is the Jaccard similarity of their digest sets, taken from the number of digests of one fingerprint
and the digests that the peeling recovered.

All of it is column expressions, linear in the length of a text but for sorting: one row needs no other row but the next
document, which is joined by id. Neighbours are found on ids alone, in blocks between quantiles of the ids, never in one
sorted partition.

Defined results: a null text counts as empty; two empty texts are alike (1), an empty and another text are not (0); very long
texts are fingerprinted whole; rows that share an id have the same next document, the next larger id (its smallest text if
several rows share it); null ids come first; the only document is its own next one; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from smoothspan.llm.scratch import cut


@dataclass(frozen=True)
class IbltSettings:
    """``share``: the difference that a fingerprint is made for, in digests for each digest of the text. ``retries``: larger
    tables that are tried, with at most ``rounds`` of peeling each. ``block_rows``: ids in a block when neighbours are looked for
    (more only beyond ``blocks`` blocks)."""

    piece_words: int = 16
    share: float = 0.5
    retries: int = 4
    rounds: int = 40
    block_rows: int = 2000
    blocks: int = 4096
    broadcast_rows: int = 500_000


def bound(value: str, name: str, use: str) -> str:
    """SQL for ``use`` with ``name`` standing for the value, computed once."""
    return f"get(transform(array({value}), {name} -> {use}), 0)"


def digests(text: Column, piece_words: int) -> Column:
    """The distinct 64-bit digests of the pieces of a text."""

    def pieces(line: Column) -> Column:
        words = F.split(line, " ")
        return F.get(
            F.transform(
                F.array(words),
                lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(piece_words)), lambda i: F.xxhash64(F.slice(w, i + 1, piece_words))),
            ),
            0,
        )

    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return F.coalesce(F.array_distinct(F.flatten(F.transform(lines, pieces))), F.array().cast("array<bigint>"))


CELL = "struct<i:int,c:int,k:bigint,h:bigint>"


def width_sql(digests: str) -> str:
    """Cells in each part, a power of two, so that all parts have about twice as many cells as there are digests."""
    return f"shiftleft(1, cast(ceil(log2(greatest(4e0, {digests} / 1.5e0))) AS int))"


def entries_sql(keys: str, sign: str, width: str, salt: str) -> str:
    """The entries of digests: each with its check hash, once in each part (the cell's place is 3 * position + part)."""

    def entry(part: int) -> str:
        return f"named_struct('i', cast((shiftrightunsigned(h, {20 * part}) & ({width} - 1)) * 3 + {part} AS int), 'c', {sign}, 'k', y, 'h', h)"

    return f"flatten(transform({keys}, y -> {bound(f'xxhash64(y, {salt})', 'h', f'array({entry(0)}, {entry(1)}, {entry(2)})')}))"


def summed_sql(entries: str) -> str:
    """The cells of entries: those of one place added up, in the order of places, without empty cells."""
    cell = (
        "aggregate(slice(e, p + 2, coalesce(get(b, q + 1), size(e)) - p - 1), named_struct('i', get(e, p).i, 'c', get(e, p).c, 'k', get(e, p).k, 'h', get(e, p).h), "
        "(x, y) -> named_struct('i', x.i, 'c', x.c + y.c, 'k', x.k ^ y.k, 'h', x.h ^ y.h))"
    )
    firsts = "filter(sequence(0, size(e) - 1), p -> p = 0 OR get(e, p).i <> get(e, p - 1).i)"
    cells = bound(firsts, "b", f"filter(transform(b, (p, q) -> {cell}), x -> x.c <> 0 OR x.k <> 0 OR x.h <> 0)")
    return bound(f"sort_array({entries})", "e", f"if(size(e) = 0, cast(array() AS array<{CELL}>), {cells})")


def table_sql(keys: str, s: IbltSettings) -> str:
    """The fingerprint's table: number of digests n, cells in a part w, and the cells."""
    made = f"named_struct('n', size(ks), 'w', w, 'cells', {summed_sql(entries_sql('ks', '1', 'w', '0'))})"
    return bound(keys, "ks", bound(width_sql(f"size(ks) * {s.share}"), "w", made))


def fingerprint_sql(table: str) -> str:
    """A table as text: digests, width, and for each cell its place, count, digest and check in hexadecimal."""
    cell = "concat(x.i, ':', x.c, ':', hex(x.k), ':', hex(x.h))"
    return f"concat({table}.n, ';', {table}.w, ';', array_join(transform({table}.cells, x -> {cell}), ','))"


def minus_sql(a: str, b: str, width: str) -> str:
    """The cells of table a less those of table b, both folded to ``width``."""

    def folded(table: str, sign: str) -> str:
        place = f"cast(((x.i div 3) & ({width} - 1)) * 3 + x.i % 3 AS int)"
        return f"transform({table}.cells, x -> named_struct('i', {place}, 'c', {sign} * x.c, 'k', x.k, 'h', x.h))"

    return summed_sql(f"concat({folded(a, '1')}, {folded(b, '-1')})")


def peel_sql(cells: str, width: str, salt: str, s: IbltSettings) -> str:
    """(cells, a, b, open): what is left of subtracted cells, and the digests found on each side."""

    def pure(side: int) -> str:
        return f"array_distinct(transform(filter(st.cells, x -> x.c = {side} AND xxhash64(x.k, {salt}) = x.h), x -> x.k))"

    removed = f"concat(st.cells, {entries_sql('pa', '-1', width, salt)}, {entries_sql('pb', '1', width, salt)})"
    done = "named_struct('cells', st.cells, 'a', st.a, 'b', st.b, 'open', false)"
    more = f"named_struct('cells', {summed_sql(removed)}, 'a', concat(st.a, pa), 'b', concat(st.b, pb), 'open', true)"
    step = bound(pure(1), "pa", bound(pure(-1), "pb", f"if(size(pa) + size(pb) = 0, {done}, {more})"))
    none = "cast(array() AS array<bigint>)"
    start = f"named_struct('cells', {cells}, 'a', {none}, 'b', {none}, 'open', true)"
    return f"aggregate(sequence(1, {s.rounds}), {start}, (st, r) -> if(st.open AND size(st.cells) > 0, {step}, st))"


def difference_sql(a: str, b: str, ta: str, tb: str, s: IbltSettings) -> str:
    """(a, b, tries, done): digests that only the first text has, that only the second has, and how many larger tables were
    built; ``retries`` + 1 tries stand for the comparison of the lists. a, b: digests; ta, tb: their tables."""

    def result(peeled: str, tries: str) -> str:
        return bound(peeled, "z", f"named_struct('a', z.a, 'b', z.b, 'tries', {tries}, 'done', size(z.cells) = 0)")

    first = bound(f"least({ta}.w, {tb}.w)", "w", result(peel_sql(minus_sql(ta, tb, "w"), "w", "0", s), "0"))
    joint = f"concat({entries_sql(a, '1', 'w', 't')}, {entries_sql(b, '-1', 'w', 't')})"
    again = bound(width_sql(f"(size({a}) + size({b})) * shiftleft(1, t - 1)"), "w", result(peel_sql(summed_sql(joint), "w", "t", s), "t"))
    tried = f"aggregate(sequence(1, {s.retries}), {first}, (v, t) -> if(v.done, v, {again}))" if s.retries else first
    lists = f"named_struct('a', array_except({a}, {b}), 'b', array_except({b}, {a}), 'tries', {s.retries + 1}, 'done', true)"
    return bound(tried, "v", f"if(v.done, v, {lists})")


def likeness_sql(difference: str, n: str) -> str:
    """The Jaccard similarity of a text of n digests and another one, from their difference."""
    return f"if({n} + size({difference}.b) = 0, 1e0, ({n} - size({difference}.a)) / cast({n} + size({difference}.b) AS double))"


def next_ids(ids: DataFrame, settings: IbltSettings) -> DataFrame:
    """(doc, n, next) of distinct (doc, n): the next larger id, after the last the first; null ids come first."""
    spark = ids.sparkSession
    total = ids.count()
    blocks = max(1, min(settings.blocks, total // settings.block_rows))
    shares = [k / blocks for k in range(1, blocks)]
    bounds = ids.select(F.percentile_approx("doc", shares, 10_000)).first()[0] if shares else None
    bounds = sorted(set(bounds or []))
    array = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    dealt = ids.withColumn("block", F.size(F.filter(array, lambda b: b <= F.col("doc"))))
    heads = dealt.groupBy("block").agg(F.min(F.struct(F.col("doc").isNotNull(), "doc")).alias("h")).select("block", F.col("h.doc").alias("head"))
    heads = sorted(heads.collect(), key=lambda r: r["block"])  # at most ``blocks`` rows
    after = [(r["block"], heads[(k + 1) % len(heads)]["head"]) for k, r in enumerate(heads)]
    kind = ids.schema["doc"].dataType.simpleString()
    after = F.broadcast(spark.createDataFrame(after, f"block int, after {kind}"))
    order = Window.partitionBy("block").orderBy(F.col("doc").asc_nulls_first())
    walked = dealt.withColumn("rank", F.lead(F.lit(1)).over(order)).withColumn("next", F.lead("doc").over(order))
    return walked.join(after, "block").select("doc", "n", F.when(F.col("rank").isNull(), F.col("after")).otherwise(F.col("next")).alias("next"))


def version_fingerprints(docs: DataFrame, settings: IbltSettings = IbltSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document against its edited text (the last quarter replaced by the start of the next document) and the next one."""
    s = settings
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    each = docs.groupBy("doc").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("rows"))
    ids = cut(each, "iblt-ids")
    repeated = not ids.where("rows > 1").isEmpty()
    walked = cut(next_ids(ids.select("doc", "n"), s), "iblt-next")
    previous = walked.select(F.col("next").alias("doc_"), F.col("doc").alias("of"), F.floor(F.col("n") / 4).cast("int").alias("take"))
    few = F.broadcast(previous) if previous.count() <= s.broadcast_rows else previous
    heads = docs.join(few, docs["doc"].eqNullSafe(few["doc_"]))
    heads = heads.select("of", F.col("text").substr(F.lit(1), F.col("take")).alias("head"), digests(F.col("text"), s.piece_words).alias("next_keys"))
    if repeated:
        heads = heads.groupBy("of").agg(F.min(F.struct("head", "next_keys")).alias("h")).select("of", "h.*")
    both = docs.join(heads, docs["doc"].eqNullSafe(heads["of"]))
    n = F.length("text")
    edit = F.floor(n / 4).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - edit), F.col("head").substr(F.lit(1), edit))
    keyed = both.select("doc", n.cast("long").alias("n_chars"), digests(F.col("text"), s.piece_words).alias("keys"), edited.alias("edited"), "next_keys")
    keyed = keyed.select("doc", "n_chars", "keys", "next_keys", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("edited"), s.piece_words).alias("edited_keys"))
    for name in ("keys", "edited_keys", "next_keys"):
        keyed = keyed.withColumn(f"of_{name}", F.expr(table_sql(name, s)))
    for name in ("edited", "next"):
        keyed = keyed.withColumn(name, F.expr(difference_sql("keys", f"{name}_keys", "of_keys", f"of_{name}_keys", s)))
    return keyed.select(
        F.col("doc").alias(id_col),
        "n_chars",
        "edited_sha256",
        F.expr(fingerprint_sql("of_keys")).alias("fingerprint"),
        F.expr(fingerprint_sql("of_edited_keys")).alias("edited_fingerprint"),
        F.expr(likeness_sql("edited", "of_keys.n")).alias("near_edited"),
        F.expr(likeness_sql("next", "of_keys.n")).alias("near_next"),
        F.col("edited.tries").alias("retries_edited"),
        F.col("next.tries").alias("retries_next"),
    )


def recovered_differences(pairs: DataFrame, old_col: str, new_col: str, settings: IbltSettings = IbltSettings()) -> DataFrame:
    """``pairs`` with the arrays ``only_old`` and ``only_new`` of digests recovered from the tables of the whole texts, and
    ``retries`` as in :func:`difference_sql`."""
    s = settings
    keyed = pairs.withColumn("a_", digests(F.col(old_col), s.piece_words)).withColumn("b_", digests(F.col(new_col), s.piece_words))
    keyed = keyed.withColumn("ta_", F.expr(table_sql("a_", s))).withColumn("tb_", F.expr(table_sql("b_", s)))
    keyed = keyed.withColumn("d_", F.expr(difference_sql("a_", "b_", "ta_", "tb_", s)))
    return keyed.select(*pairs.columns, F.col("d_.a").alias("only_old"), F.col("d_.b").alias("only_new"), F.col("d_.tries").alias("retries"))
