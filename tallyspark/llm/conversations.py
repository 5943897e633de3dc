"""Chat formatting: linking quotations to the messages that they quote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyspark.llm.common import cut, table

#: The marks that quote a line, at its beginning; each one is a level.
MARKS = r"^[\x20\x09]*(?:>[\x20\x09]*)+"


def level(line: Column) -> Column:
    """How many times over a line is quoted."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), r"[^>]", ""))


def passage_key(line: Column) -> Column:
    """A hash of a line without its quotation marks, with letters folded and white space squeezed; null for lines without letters or digits."""
    body = F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), r"[\x20\x09-\x0D]+", " "))
    return F.when(body.rlike(r"[\p{L}\p{N}]"), F.sha2(body, 256))


def own_text(text: Column | str) -> Column:
    """A message without the lines that it quotes, and without empty lines at its ends."""
    kept = F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike(MARKS))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^(?:[\x20\x09]*\n)+|(?:\n[\x20\x09]*)+$", "")


def link_quotes(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, parent_turn, n_lines): for each message and quote level, the messages that its quoted lines come from.

    A quoted line belongs to the first message of its conversation that says it
    unquoted, if that is an earlier turn. Originals are reduced to one row for
    each conversation and line before the join, so a line that very many
    messages repeat or quote meets one row.
    """
    lines = messages.where("text is not null").select("conv_id", "turn", F.explode(F.split("text", "\n", -1)).alias("_line"))
    lines = lines.select("conv_id", "turn", level(F.col("_line")).alias("level"), passage_key(F.col("_line")).alias("_key")).where("_key is not null")
    said = lines.where("level = 0").groupBy("conv_id", "_key").agg(F.min("turn").alias("parent_turn"))
    said = said.select(F.col("conv_id").alias("_conv"), F.col("_key").alias("_said"), "parent_turn")
    quoted = lines.where("level > 0").groupBy("conv_id", "turn", "level", "_key").agg(F.count(F.lit(1)).alias("_n"))
    met = quoted.join(said, quoted["conv_id"].eqNullSafe(said["_conv"]) & (quoted["_key"] == said["_said"])).where("parent_turn < turn")
    return met.groupBy("conv_id", "turn", "level", "parent_turn").agg(F.sum("_n").alias("n_lines"))


def parents(links: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn): the message that each one answers.

    That is the one most of its lines of the outermost quote level come from,
    the latest of equals; deeper levels count only if the outer ones link to
    nothing.
    """
    best = F.max_by("parent_turn", F.struct(-F.col("level"), "n_lines", "parent_turn"))
    return links.groupBy("conv_id", "turn").agg(best.alias("parent_turn"))


def threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth) of messages (conv_id, turn, parent_turn) with a parent: pointer doubling up the chains.

    Every round doubles the distance that a message looks up, so a chain of n
    replies takes log2(n) joins. Turns only point to earlier ones: no circles.
    """
    state = cut(replies.select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).cast("long").alias("steps")))
    while True:
        above = state.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("up").alias("_up"), F.col("steps").alias("_steps"))
        same = state["conv_id"].eqNullSafe(above["_conv"]) & (state["up"] == above["_turn"])
        joined = state.join(above, same, "left")
        new = joined.select("conv_id", "turn", F.coalesce("_up", "up").alias("up"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.col("_up").isNotNull().alias("_moved"))
        new = cut(new)
        moved = new.where("_moved").limit(1).count()
        state = new.drop("_moved")
        if not moved:
            return state.select("conv_id", "turn", F.col("up").alias("root_turn"), F.col("steps").alias("depth"))


def positions(messages: DataFrame, order: list[str], parts: int) -> DataFrame:
    """``messages`` with ``position``, its place from 0 on among its conversation's in the given order.

    Rows are range-partitioned by conversation and order; a row's place is its
    rank in its partition plus the conversation's rows in the partitions before.
    A conversation of any length spreads over partitions.
    """
    ranged = cut(messages.repartitionByRange(parts, "conv_id", *order).sortWithinPartitions("conv_id", *order).withColumn("_part", F.spark_partition_id()))
    inside = W.partitionBy("_part", "conv_id").orderBy(*order)
    counts = ranged.groupBy("conv_id", "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(W.partitionBy("conv_id").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(F.col("conv_id").alias("_conv"), F.col("_part").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = ranged.withColumn("_rank", F.row_number().over(inside) - 1)
    same = ranked["conv_id"].eqNullSafe(counts["_conv"]) & (ranked["_part"] == counts["_of"])
    return ranked.join(counts, same).withColumn("position", (F.col("_before") + F.col("_rank")).cast("long")).drop("_conv", "_of", "_before", "_rank", "_part")


def reply_ordered(messages: DataFrame, parts: int | None = None) -> DataFrame:
    """(conv_id, turn, role, text, parent_turn, root_turn, depth, position) for each message.

    ``text`` has lost its quoted lines; ``parent_turn`` is the message it
    answers, null where nothing links; a thread is a root with all that answers
    it. Messages are ordered by thread, then by depth, then by turn, so that
    each follows what it answers. Null texts stay null and quote nothing; null
    conversations are one conversation; a null turn links to nothing and comes
    first. Messages that repeat a turn get the same links and places of their
    own, by role and text. Further columns are ignored; an empty table gives no
    rows.
    """
    links = cut(parents(link_quotes(messages)))
    chains = threads(links)
    own = links.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), "parent_turn")
    placed = chains.join(own, F.expr("conv_id <=> _conv AND turn = _turn"))
    placed = placed.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), "parent_turn", "root_turn", "depth")
    rows = messages.select("conv_id", "turn", "role", own_text("text").alias("text"))
    rows = rows.join(placed, F.expr("conv_id <=> _conv AND turn = _turn"), "left")
    rows = rows.select("conv_id", "turn", "role", "text", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))
    parts = parts or int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return positions(rows, ["root_turn", "depth", "turn", "role", "text"], parts)


def op5_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_ordered(table(spark, sf_dir, "conversations"))


def _oracle() -> str:
    return r"""
WITH RECURSIVE l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations),
k AS (SELECT conv_id, turn, len(regexp_replace(regexp_extract(line, '^[ \t]*(?:>[ \t]*)+'), '[^>]', '', 'g')) AS level,
      trim(regexp_replace(lower(regexp_replace(line, '^[ \t]*(?:>[ \t]*)+', '')), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS body FROM l),
v AS (SELECT * FROM k WHERE regexp_matches(body, '[\p{L}\p{N}]')),
said AS (SELECT conv_id, body, min(turn) AS parent_turn FROM v WHERE level = 0 GROUP BY ALL),
links AS (SELECT q.conv_id, q.turn, q.level, s.parent_turn, count(*) AS n FROM v q JOIN said s ON q.conv_id = s.conv_id AND q.body = s.body
          WHERE q.level > 0 AND s.parent_turn < q.turn GROUP BY ALL),
p AS (SELECT conv_id, turn, parent_turn FROM links QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, parent_turn DESC) = 1),
up(conv_id, turn, root_turn, depth) AS (
  SELECT conv_id, turn, parent_turn, 1 FROM p
  UNION ALL SELECT u.conv_id, u.turn, p.parent_turn, u.depth + 1 FROM up u JOIN p ON p.conv_id = u.conv_id AND p.turn = u.root_turn),
top AS (SELECT conv_id, turn, min(root_turn) AS root_turn, max(depth) AS depth FROM up GROUP BY ALL),
m AS (SELECT c.conv_id, c.turn, c.role, p.parent_turn, coalesce(t.root_turn, c.turn) AS root_turn, coalesce(t.depth, 0)::BIGINT AS depth,
      regexp_replace(array_to_string([x FOR x IN string_split(c.text, chr(10)) IF NOT regexp_matches(x, '^[ \t]*(?:>[ \t]*)+')], chr(10)), '^([ \t]*\n)+|(\n[ \t]*)+$', '', 'g') AS text
      FROM conversations c LEFT JOIN p USING (conv_id, turn) LEFT JOIN top t USING (conv_id, turn))
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY root_turn, depth, turn, role, text) - 1 AS position FROM m"""


QUERIES = {"op5_conversations": op5_conversations}
ORACLES = {"op5_conversations": _oracle()}
