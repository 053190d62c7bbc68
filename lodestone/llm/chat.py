"""Chat formatting with cumulative-snapshot collapse (operator 8), in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A turn in the rendered text: role, then text.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def snapshots(turns: DataFrame) -> DataFrame:
    """conv_id, place, a, b and last of each distinct turn: 128 bits of rolling hash over the turns up to it.

    Turns are in order of (turn, role, text), null turns first, as they are rendered. The hash is the exclusive or of
    hashes of role, text and place, so a window rolls it forward; nothing grows with a conversation but its rows.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    seen = (F.row_number().over(order) > 1) & F.lag("turn").over(order).eqNullSafe(F.col("turn")) & (F.lag("role").over(order) == F.col("role")) & (F.lag("text").over(order) == F.col("text"))
    new = rows.withColumn("seen", seen).where("not seen")
    placed = new.select("conv_id", F.row_number().over(order).alias("place"), *[F.xxhash64(F.lit(k), "role", "text").alias(k) for k in ("a", "b")])
    by_place = Window.partitionBy("conv_id").orderBy("place")
    rolled = [F.bit_xor(F.xxhash64(k, "place")).over(by_place.rowsBetween(Window.unboundedPreceding, 0)).alias(k) for k in ("a", "b")]
    return placed.select("conv_id", "place", *rolled, F.lead("place").over(by_place).isNull().alias("last"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id of the conversations that are no prefix of a longer one; of equal ones the smallest conv_id stays.

    Conversations are equal from the start if their last rolling hashes are, found by partial aggregation; one is a
    prefix of a longer one if its last hash is an inner hash of another, found by an anti-join against the distinct
    inner hashes.
    """
    chains = snapshots(turns)
    whole = chains.where("last").groupBy("a", "b", "place").agg(F.min("conv_id").alias("conv_id"))
    inner = chains.where("not last").select("a", "b", "place").distinct()
    return whole.join(inner, ["a", "b", "place"], "left_anti").select("conv_id")


def format_conversations(turns: DataFrame) -> DataFrame:
    """Collapse snapshots of ``turns`` (conv_id, turn, role, text) and render what stays: conv_id, n_turns, rendered.

    Turns are in order of (turn, role, text), null turns first; null role and text count as empty; repeated rows count
    once; other columns are ignored. Rows without conv_id belong to no conversation and are left out. An empty table
    gives an empty result.
    """
    kept = turns.join(maximal_conversations(turns), "conv_id", "left_semi")
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = kept.groupBy("conv_id").agg(F.sort_array(F.collect_set(turn)).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")
    return whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), text.alias("rendered"))


SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS ts FROM t GROUP BY conv_id),
whole AS (SELECT min(conv_id) AS conv_id, ts FROM c GROUP BY ts),
inner_ AS (SELECT DISTINCT ts[1:k] AS ts FROM (SELECT ts, unnest(range(1, len(ts))) AS k FROM whole))
SELECT conv_id, CAST(len(ts) AS BIGINT) AS n_turns,
       array_to_string(list_transform(ts, lambda x: '<|im_start|>' || x.r || chr(10) || x.t || '<|im_end|>' || chr(10)), '') AS rendered
FROM whole ANTI JOIN inner_ USING (ts)
"""
