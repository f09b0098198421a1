"""Chat formatting of preferences (operator 8). Native: DataFrame functions only.

Method: a pair is a chosen and a rejected conversation. Their longest common prefix of turns (same role, same text) is
rendered once as the prompt; what remains of each is its completion. Every completion comes with the spans of code points that a
loss should count: assistants' texts with their end marks; the rest (roles, other speakers' turns) is masked.

Scale. The turns of both sides are sent to the pair's partition in one shuffle; positions, comparison, prefix length and offsets
are windows over that partitioning. A conversation that occurs in many pairs is read once a pair. The rendering of one pair
is one row, as long as its conversations; nothing larger is gathered.

Defined cases: turns are ordered by turn, then role, then text, so ties and repeated rows have one order; null role or text
is the empty string; a pair of equal conversations is all prompt with empty completions; one of whose sides has no turns is no
pair and is left out; the marks of the format are broken up where a text or role contains them; an empty table gives an empty
result; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BEGIN, END = "<|im_start|>", "<|im_end|>"


def unmarked(c: Column) -> Column:
    return F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def neighbours(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(pair, chosen, rejected): conversations 2k and 2k + 1, for every k where both exist; k is exact for every long."""
    ids = turns.select(F.col(conv_col).cast("long").alias("c")).where("c IS NOT NULL")
    return ids.groupBy(F.shiftright("c", 1).alias("pair")).agg(F.min("c").alias("chosen"), F.max("c").alias("rejected")).where("chosen < rejected")


def format_pairs(turns: DataFrame, pairs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``pairs``: pair, chosen, rejected. One row a pair: pair, prompt, chosen, rejected (strings), n_prompt, n_chosen, n_rejected
    (turns, long), chosen_spans, rejected_spans (array of start, stop: code points that count)."""
    said = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), unmarked(F.col(role_col)).alias("role"), unmarked(F.col(text_col)).alias("text"))
    sides = pairs.select("pair", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("chosen").alias("conv")), F.struct(F.lit(1).alias("side"), F.col("rejected").alias("conv")))).alias("s")).select("pair", "s.*")
    rows = said.join(sides, "conv").repartition("pair")
    rows = rows.withColumn("pos", F.row_number().over(W.partitionBy("pair", "side").orderBy("turn", "role", "text")))
    both = W.partitionBy("pair", "pos")
    what = F.struct("role", "text")
    rows = rows.withColumn("same", (F.count("*").over(both) == 2) & (F.min(what).over(both) == F.max(what).over(both)))
    pair = W.partitionBy("pair")
    rows = rows.withColumns({"split": F.coalesce(F.min(F.when(~F.col("same"), F.col("pos"))).over(pair), F.lit(2**31 - 1)), "sides": F.max("side").over(pair) - F.min("side").over(pair)})
    rows = rows.where((F.col("sides") == 1) & ((F.col("pos") >= F.col("split")) | (F.col("side") == 0)))
    part = F.when(F.col("pos") < F.col("split"), F.lit(0)).otherwise(F.col("side") + 1)
    rows = rows.select("pair", part.alias("part"), "pos", "role", F.concat(F.lit(BEGIN), "role", F.lit("\n")).alias("head"), F.concat("text", F.lit(END)).alias("body"))
    line = F.concat("head", "body", F.lit("\n"))
    before = F.coalesce(F.sum(F.char_length(line)).over(W.partitionBy("pair", "part").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.select("pair", "part", "pos", line.alias("line"), (F.col("role") == "assistant").alias("counts"), (before + F.char_length("head")).alias("start"), (before + F.char_length("head") + F.char_length("body")).alias("stop"))

    def rendered(k: int) -> Column:
        own = F.sort_array(F.collect_list(F.when(F.col("part") == k, F.struct("pos", "line"))))
        return F.array_join(F.transform(own, lambda x: x["line"]), "")

    def spans(k: int) -> Column:
        return F.sort_array(F.collect_list(F.when((F.col("part") == k) & F.col("counts"), F.struct("start", "stop"))))

    return rows.groupBy("pair").agg(
        rendered(0).alias("prompt"), rendered(1).alias("chosen"), rendered(2).alias("rejected"),
        *(F.count_if(F.col("part") == k).alias(n) for k, n in enumerate(("n_prompt", "n_chosen", "n_rejected"))),
        spans(1).alias("chosen_spans"), spans(2).alias("rejected_spans"),
    )
