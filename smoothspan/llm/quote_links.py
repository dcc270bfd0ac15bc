"""Quotation linking and reply order of conversations.

The lines of a message have quote levels (the number of ``>`` marks in front). Runs of lines of one level without empty lines
are passages; a passage is normalised (lower case, white space and quote marks folded) and hashed. The passages of level 0 are
a message's own text. A quoted passage is linked to the earliest message of its conversation that has the passage as its own
text, if that message is earlier than the quoting one. A message replies to the latest message linked by its passages of the
lowest quote level that has links. Messages are ordered by the first message of their reply tree, then by turn, so that each
reply follows the message that it replies to.

All steps are DataFrame expressions. Origins are aggregated before the join, so a quote joins one row; roots are found by
doubling the reply pointers (one join for each doubling); positions come from a range-partitioned sort with offsets for each
partition, so a conversation that holds a third of all rows is spread over tasks.

Defined results: a null or empty text has no passages; messages without conversation or turn are not linked, are their own
roots and come first in the order; rows that share conversation and turn are parts of one message: they share links and
parent, and follow each other ordered by role and text; passages quoted from nowhere are kept as unlinked; very long messages are read whole; an empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from smoothspan.llm.scratch import cut

QUOTE_MARKS = r"^[ \t]*(>[> \t]*)"


def parsed_lines(text: Column) -> Column:
    """array<struct<level, body>> of the lines of a text."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    marks = lambda line: F.regexp_extract(line, QUOTE_MARKS, 1)
    return F.transform(
        lines,
        lambda line: F.struct(F.length(F.translate(marks(line), " \t", "")).alias("level"), F.regexp_replace(line, QUOTE_MARKS, "").alias("body")),
    )


def normalised(body: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(body), r"[ \t\r]+", " "))


def passages(lines: Column) -> Column:
    """array<struct<level, hash>> of the runs of lines with one level; empty lines end a run."""
    full = F.transform(lines, lambda x: F.struct(x["level"].alias("level"), normalised(x["body"]).alias("body")))

    def runs(x: Column) -> Column:
        number = F.sequence(F.lit(1), F.size(x))
        blank = lambda i: F.element_at(x, i)["body"] == ""
        starts = F.filter(
            number,
            lambda i: ~blank(i) & ((i == 1) | F.when(i > 1, blank(F.greatest(i - 1, F.lit(1))) | (F.element_at(x, F.greatest(i - 1, F.lit(1)))["level"] != F.element_at(x, i)["level"]))),
        )
        ends = F.filter(
            number,
            lambda i: ~blank(i) & ((i == F.size(x)) | F.when(i < F.size(x), blank(F.least(i + 1, F.size(x))) | (F.element_at(x, F.least(i + 1, F.size(x)))["level"] != F.element_at(x, i)["level"]))),
        )
        return F.zip_with(
            starts,
            ends,
            lambda a, b: F.struct(
                F.element_at(x, a)["level"].alias("level"),
                F.md5(F.array_join(F.transform(F.slice(x, a, b - a + 1), lambda y: y["body"]), " ")).alias("hash"),
            ),
        )

    return F.get(F.transform(F.array(full), runs), 0)


def linked_quotes(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, hash, origin) of every quoted passage of (conv, turn, lines); origin is null if there is none."""
    found = messages.where("conv IS NOT NULL AND turn IS NOT NULL").select("conv", "turn", F.explode_outer(passages(F.col("lines"))).alias("p"))
    found = found.select("conv", "turn", F.col("p.level").alias("level"), F.col("p.hash").alias("hash"))
    own = found.where("level = 0").groupBy("conv", "hash").agg(F.min("turn").alias("origin"))
    quoted = found.where("level > 0").distinct()
    joined = quoted.join(own, ["conv", "hash"], "left")
    return joined.select("conv", "turn", "level", "hash", F.when(F.col("origin") < F.col("turn"), F.col("origin")).alias("origin"))


def reply_roots(parents: DataFrame) -> DataFrame:
    """(conv, turn, root, depth) of (conv, turn, parent): pointers are doubled until each points at a root."""
    state = cut(parents.select("conv", "turn", F.col("parent").alias("up"), F.lit(1).cast("long").alias("steps")), "quotes-parents")
    while True:
        above = state.select("conv", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("more"))
        moved = state.join(above, ["conv", "up"], "left")
        moved = moved.select("conv", "turn", F.coalesce("up2", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("up2").isNotNull().alias("moved"))
        moved = cut(moved, "quotes-roots")
        if moved.where("moved").isEmpty():
            return moved.select("conv", "turn", F.col("up").alias("root"), F.col("steps").alias("depth"))
        state = moved.drop("moved")


def numbered(df: DataFrame, group: str, order: list[Column], out: str) -> DataFrame:
    """``df`` with positions from 0 within ``group``, counted over a range-partitioned sort."""
    sort = [F.col(group).asc_nulls_first(), *order]
    placed = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    placed = cut(placed.withColumn("row_", F.monotonically_increasing_id()), "quotes-sorted")
    part = F.shiftright("row_", 33)
    counts = placed.groupBy(F.col(group).alias("g_"), part.alias("part_")).agg(F.count("*").alias("n_"), F.min("row_").alias("first_"))
    before = Window.partitionBy("g_").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before_", F.coalesce(F.sum("n_").over(before), F.lit(0))).select("g_", "part_", "first_", "before_")
    joined = placed.join(offsets, placed[group].eqNullSafe(offsets["g_"]) & (part == offsets["part_"]))
    return joined.withColumn(out, F.col("before_") + F.col("row_") - F.col("first_")).drop("row_", "g_", "part_", "first_", "before_")


def link_conversations(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Messages without quotes in reply order: (conv, turn, role, position, parent, root, depth, n_quotes, n_linked, text)."""
    base = messages.select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).alias("role"),
        F.col(text_col).alias("text"),
        parsed_lines(F.col(text_col)).alias("lines"),
    )
    quotes = cut(linked_quotes(base), "quotes-links")
    lowest = quotes.groupBy("conv", "turn").agg(
        F.count("*").alias("n_quotes"),
        F.count("origin").alias("n_linked"),
        F.max(F.when(F.col("origin").isNotNull(), F.struct((-F.col("level")).alias("l"), "origin"))).alias("best"),
    )
    lowest = lowest.select("conv", "turn", "n_quotes", "n_linked", F.col("best.origin").alias("parent"))
    roots = reply_roots(lowest.where("parent IS NOT NULL"))
    facts = lowest.join(roots, ["conv", "turn"], "left")
    kept = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    clean = base.select("conv", "turn", "role", F.when(F.col("text").isNull(), None).otherwise(F.btrim(kept, F.lit(" \n\t\r"))).alias("text"))
    joined = clean.join(facts, ["conv", "turn"], "left").withColumn("root", F.coalesce("root", "turn"))
    order = [F.col(c).asc_nulls_first() for c in ("root", "turn", "role", "text")]
    placed = numbered(joined, "conv", order, "position")
    zero = F.lit(0).cast("long")
    return placed.select(
        F.col("conv").alias(conv_col),
        F.col("turn").alias(turn_col),
        F.col("role").alias(role_col),
        "position",
        "parent",
        "root",
        F.coalesce("depth", zero).alias("depth"),
        F.coalesce("n_quotes", zero).alias("n_quotes"),
        F.coalesce("n_linked", zero).alias("n_linked"),
        F.col("text").alias(text_col),
    )


ORACLE_SQL = r"""
WITH RECURSIVE lines AS (
  SELECT conv_id, turn, i,
         length(translate(regexp_extract(line, '^[ \t]*(>[> \t]*)', 1), chr(32) || chr(9), '')) AS level,
         trim(regexp_replace(lower(regexp_replace(line, '^[ \t]*(>[> \t]*)', '')), '[ \t\r]+', ' ', 'g')) AS body
  FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM conversations)
), before AS (
  SELECT *, lag(body) OVER w AS body_before, lag(level) OVER w AS level_before FROM lines WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)
), runs AS (
  SELECT *, sum(CASE WHEN body <> '' AND (body_before IS NULL OR body_before = '' OR level_before <> level) THEN 1 ELSE 0 END)
            OVER (PARTITION BY conv_id, turn ORDER BY i ROWS UNBOUNDED PRECEDING) AS run
  FROM before
), passages AS (
  SELECT conv_id, turn, min(level) AS level, md5(string_agg(body, ' ' ORDER BY i)) AS hash FROM runs WHERE body <> '' GROUP BY conv_id, turn, run
), own AS (SELECT conv_id, hash, min(turn) AS origin FROM passages WHERE level = 0 GROUP BY 1, 2),
quotes AS (
  SELECT q.conv_id, q.turn, q.level, q.hash, CASE WHEN o.origin < q.turn THEN o.origin END AS origin
  FROM (SELECT DISTINCT * FROM passages WHERE level > 0) q LEFT JOIN own o USING (conv_id, hash)
), facts AS (
  SELECT conv_id, turn, count(*) AS n_quotes, count(origin) AS n_linked,
         max(origin) FILTER (WHERE origin IS NOT NULL AND level = low) AS parent
  FROM (SELECT *, min(level) FILTER (WHERE origin IS NOT NULL) OVER (PARTITION BY conv_id, turn) AS low FROM quotes) GROUP BY 1, 2
), tree AS (
  SELECT conv_id, turn, parent AS root, CAST(1 AS BIGINT) AS depth FROM facts WHERE parent IS NOT NULL
  UNION ALL
  SELECT t.conv_id, t.turn, f.parent, t.depth + 1 FROM tree t JOIN facts f ON f.conv_id = t.conv_id AND f.turn = t.root AND f.parent IS NOT NULL
), roots AS (SELECT conv_id, turn, min(root) AS root, max(depth) AS depth FROM tree GROUP BY 1, 2),
clean AS (
  SELECT conv_id, turn, role, trim(coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '^[ \t]*>')), chr(10)), ''), ' ' || chr(10) || chr(9) || chr(13)) AS text
  FROM conversations
), joined AS (
  SELECT c.conv_id, c.turn, c.role, f.parent, coalesce(r.root, c.turn) AS root, coalesce(r.depth, 0) AS depth,
         coalesce(f.n_quotes, 0) AS n_quotes, coalesce(f.n_linked, 0) AS n_linked, c.text
  FROM clean c LEFT JOIN facts f USING (conv_id, turn) LEFT JOIN roots r USING (conv_id, turn)
)
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY root, turn, role, text) - 1 AS position, parent, root, depth, n_quotes, n_linked, text
FROM joined
"""
