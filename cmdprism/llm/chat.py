"""Chat formatting with DataFrame functions only: collapse of cumulative snapshots, then rendering.

A conversation logged again after every turn leaves many rows that begin alike. Each turn gets a 128-bit digest of its
messages and its number, and the digests up to a turn, combined with exclusive or, identify the prefix that ends
there. Conversations with the same whole digest are one class, of which the smallest id stays. A class is a snapshot if its
digest is that of a proper prefix of another conversation: an anti-join keeps the classes that aren't. Only what stays is
rendered, in parts of ``PART_TURNS`` turn numbers. A part of more than ``PART_BYTES`` is cut into pieces by a running total
over ranges of its messages, so no conversation and no part has to fit into one row or task, whatever its turns are.

Defined results: messages of one turn are a set, in the order of role and text: a repeated row counts once. A null
turn comes before all others; null roles and texts are rendered as empty, but differ from empty ones in comparisons. Rows
with a null conversation id are one conversation. Pieces are parts of their own: they and the later parts of their
conversation have higher numbers, ascending, with gaps. Only a message longer than ``PART_BYTES`` makes a longer row.
Empty tables give no rows; extra columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cmdprism.plans.prefix import in_ranges, running_totals
from cmdprism.sources.tables import materialize

#: Turn numbers that one rendered part covers; also the share of a conversation that one window sees.
PART_TURNS = 512
#: Bytes of messages that one rendered row holds, and what a message counts besides its role and text.
PART_BYTES, MESSAGE_BYTES = 16 << 20, 64
SEEDS = (101, 202)


def part_of(turn: Column) -> Column:
    return F.coalesce(F.floor(turn / PART_TURNS).cast("long"), F.lit(-(2**62)))


def message_key(seed: int) -> Column:
    """64 bits of a message; nulls differ from empty texts."""
    return F.xxhash64(F.lit(seed), F.struct(F.col("role").isNull(), "role", F.col("text").isNull(), "text"))


def turn_digests(messages: DataFrame) -> DataFrame:
    """One row per conversation and turn: part and two digests; partial sums meet, so a long turn is no large group."""
    distinct = messages.select("conv_id", "turn", *[message_key(s).alias(f"m{s}") for s in SEEDS]).distinct()
    keys = distinct.groupBy("conv_id", "turn").agg(*[F.bit_xor(f"m{s}").alias(f"m{s}") for s in SEEDS], F.count("*").alias("n"))
    return keys.select(
        "conv_id",
        "turn",
        part_of(F.col("turn")).alias("part"),
        *[F.xxhash64(F.lit(s), "turn", F.col("turn").isNull(), "n", *[f"m{x}" for x in SEEDS]).alias(f"d{s}") for s in SEEDS],
    )


def prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefix digests (conv_id, p101, p202, last) after every turn, and (conv_id, part) of all parts.

    Digests are combined within parts, then the parts' totals before are added. Parts stand in ranges of bounded size (where turns are
    time stamps, every turn is a part), so a window sees one part of a conversation, the parts of one range, or one row per range.
    """
    digests = [f"d{s}" for s in SEEDS]
    totals = turns.groupBy("conv_id", "part").agg(*[F.bit_xor(d).alias(d) for d in digests], F.max("turn").alias("end"))
    placed = in_ranges(totals, ["conv_id"], [F.col("part")], "chat-parts")
    per_range = placed.groupBy("conv_id", "_range").agg(*[F.bit_xor(d).alias(d) for d in digests])
    ahead = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0).cast("long")
    ranges = per_range.select(
        F.col("conv_id").alias("_conv"), F.col("_range").alias("_at"),
        F.lead("_range").over(Window.partitionBy("conv_id").orderBy("_range")).isNull().alias("_last_range"),
        *[F.coalesce(F.bit_xor(d).over(ahead), nothing).alias(f"_{d}") for d in digests],
    )
    after = Window.partitionBy("conv_id", "_range").orderBy("part")
    before = after.rowsBetween(Window.unboundedPreceding, -1)
    same_range = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_range") == F.col("_at"))
    offsets = placed.join(ranges, same_range).select(
        F.col("conv_id").alias("_conv"),
        F.col("part").alias("_part"),
        (F.col("_last_range") & F.lead("part").over(after).isNull()).alias("_last_part"),
        F.col("end").alias("_end"),
        *[F.coalesce(F.bit_xor(d).over(before), nothing).bitwiseXOR(F.col(f"_{d}")).alias(f"_{d}") for d in digests],
    )
    within = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))
    rows = turns.join(offsets, same).select(
        "conv_id",
        (F.col("_last_part") & F.col("turn").eqNullSafe(F.col("_end"))).alias("last"),
        *[F.bit_xor(d).over(within).bitwiseXOR(F.col(f"_{d}")).alias(f"p{s}") for s, d in zip(SEEDS, digests, strict=True)],
    )
    return rows, placed.select("conv_id", "part")


def maximal(messages: DataFrame) -> DataFrame:
    """(conv_id, part, snapshots): parts of the conversations that stay; ``snapshots`` counts equal conversations."""
    turns = materialize(turn_digests(messages), "chat-turns")
    rows, parts = prefixes(turns)
    rows = materialize(rows, "chat-prefixes")
    keys = [f"p{s}" for s in SEEDS]
    whole = rows.where("last").groupBy(*keys).agg(
        F.min("conv_id").alias("conv_id"), F.max(F.col("conv_id").isNull()).alias("has_null"), F.count("*").alias("snapshots")
    )
    proper = rows.where("not last").select(*keys).distinct()
    kept = whole.join(proper, keys, "left_anti").select(
        F.col("conv_id").alias("_kept"), "snapshots"
    )
    return parts.join(kept, F.col("conv_id").eqNullSafe(F.col("_kept"))).select("conv_id", "part", "snapshots")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def same_part(conv: str = "_conv", part: str = "_part") -> Column:
    return F.col("conv_id").eqNullSafe(F.col(conv)) & (F.col("part") == F.col(part))


def in_pieces(rows: DataFrame, large: DataFrame, part_bytes: int) -> DataFrame:
    """The messages of the large parts that stay, with their piece."""
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    distinct = rows.join(large.where("snapshots IS NOT NULL"), same_part()).drop("_conv", "_part").distinct()
    placed = running_totals(distinct, ["conv_id", "part"], order, ["cost"])
    return materialize(placed.withColumn("piece", F.floor(F.col("cost_before") / part_bytes).cast("long")), "chat-pieces")


def part_numbers(kept: DataFrame, pieces: DataFrame, part_bytes: int) -> DataFrame:
    """(_conv, _part, shift): how many numbers the parts before take more, by a running total over ranges of parts."""
    more = pieces.groupBy("conv_id", "part").agg(F.floor(F.max("cost_total") / part_bytes).cast("long").alias("extra"))
    named = more.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "extra")
    every = kept.select(F.col("_kept").alias("conv_id"), F.col("_kept_part").alias("part")).join(named, same_part(), "left")
    counted = running_totals(every.select("conv_id", "part", F.coalesce("extra", F.lit(0)).alias("extra")), ["conv_id"], [F.col("part")], ["extra"])
    return counted.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.col("extra_before").alias("shift"))


def format_chats(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """conv_id, part, n_messages, snapshots, rendered: the maximal conversations, part after part."""
    messages = conversations.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).alias("role"),
        F.col(text_col).alias("text"),
    )
    kept = materialize(maximal(messages), "chat-kept")
    kept = kept.select(F.col("conv_id").alias("_kept"), F.col("part").alias("_kept_part"), "snapshots")
    cost = F.coalesce(F.octet_length("role"), F.lit(0)) + F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(MESSAGE_BYTES)
    rows = messages.withColumns({"part": part_of(F.col("turn")), "cost": cost.cast("long")})
    sizes = rows.groupBy("conv_id", "part").agg(F.sum("cost").alias("total")).where(F.col("total") > part_bytes)
    large = sizes.join(kept, same_part("_kept", "_kept_part"), "left")
    large = materialize(large.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "snapshots"), "chat-large")
    cut = not large.isEmpty()
    small = rows.join(large, same_part(), "left_anti") if cut else rows
    held = small.join(kept, same_part("_kept", "_kept_part")).withColumn("piece", F.lit(0).cast("long"))
    names = ["conv_id", "part", "piece", "turn", "role", "text", "snapshots"]
    held = held.select(*names)
    if cut:
        pieces = in_pieces(rows, large, part_bytes)
        held = held.unionByName(pieces.select(*names))
    # A part's messages in order: turn (null first), role, text.
    ordered = F.sort_array(F.collect_set(F.struct("turn", "role", "text")))
    parts = held.groupBy("conv_id", "part", "piece").agg(ordered.alias("held"), F.max("snapshots").alias("snapshots"))
    number = F.col("part")
    if cut:
        parts = parts.join(part_numbers(kept, pieces, part_bytes), same_part())
        number = number + F.col("piece") + F.col("shift")
    return parts.select(
        "conv_id",
        number.alias("part"),
        F.size("held").cast("long").alias("n_messages"),
        "snapshots",
        F.array_join(F.transform("held", lambda m: rendered(m["role"], m["text"])), "").alias("rendered"),
    )


def op2(conversations: DataFrame) -> DataFrame:
    return format_chats(conversations)


#: The same result in plain SQL: prefixes are compared as whole strings.
OP2_SQL = """
WITH messages AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations
), turns AS (
  SELECT conv_id, turn,
         string_agg(coalesce('r' || length(role) || ':' || role, 'null') || coalesce('t' || length(text) || ':' || text, 'null'), ''
                    ORDER BY role NULLS FIRST, text NULLS FIRST) AS body
  FROM messages GROUP BY conv_id, turn
), prefixes AS (
  SELECT conv_id, turn,
         string_agg('#' || coalesce(turn::VARCHAR, 'null') || '=' || body, '')
           OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST ROWS UNBOUNDED PRECEDING) AS prefix,
         lead(1) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) IS NULL AS is_last
  FROM turns
), whole AS (
  SELECT prefix, min(conv_id) AS conv_id, count(*) AS snapshots FROM prefixes WHERE is_last GROUP BY prefix
), kept AS (
  SELECT conv_id, snapshots FROM whole
  WHERE prefix NOT IN (SELECT prefix FROM prefixes WHERE NOT is_last)
)
SELECT m.conv_id, coalesce(floor(m.turn / 512)::BIGINT, -4611686018427387904) AS part, count(*) AS n_messages, max(snapshots) AS snapshots,
       string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), ''
                  ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
FROM messages m JOIN kept k ON m.conv_id IS NOT DISTINCT FROM k.conv_id
GROUP BY m.conv_id, floor(m.turn / 512)::BIGINT
"""
