"""Mixing sources to target weights (operator 3). Native: DataFrame functions only.

Method: hierarchical budgeting. Documents hang on a tree domain - language - source. The token budget goes down from the root:
children share their parent's budget by weight, none above its capacity (its tokens times ``max_epochs``), and what
one can't take goes to its siblings by weight. As a parent's capacity is the sum of its children's, a shortage reaches the
parent's siblings only when all siblings are full. Each leaf then takes whole seeded epochs, and of the last one the longest
prefix, in an order drawn from the seed, the epoch and the id, whose tokens fit the rest of its budget.

The capped shares have a closed form, so there is no iteration: by rising capacity per weight, a child is full iff
(capacities before it) * weight + capacity * (weights from it on) <= budget * weight. All sums are exact integers.

Scale. The tree is an aggregate; its levels are windows over it: the largest holds the sources of one language of one domain, the root's the domains.
The prefix of a leaf is found from sums over 256 ranges of the order key, which are combined before the shuffle, then over 256 ranges of the one range in which the
prefix ends, then by a sort within the last of these. So a source that holds a
third of all rows is never sorted or gathered as one (a 65,536th of it is), and texts are not shuffled at all. Leaf table and cut table hold one row a leaf,
are written, and are broadcast by Spark if it finds their files small enough.

Defined cases: null source or language counts as the empty name, null text as no tokens; a document without tokens costs nothing and
comes with the prefix of its leaf if its place in the order does; rows of one id are taken or left together; nodes of weight 0 get nothing; nodes that the
weights don't name weigh 1; nodes of equal capacity per weight are served in the order of their names; a text of any length is one row's count; an empty table gives an empty result; other columns pass through, one named like an output is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import unpacked, written

LEVELS = ["domain", "lang", "source"]
Weights = dict[tuple[str, ...], int]


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t-\r]+")).cast("long")


def weight_of(level: int, weights: Weights, default: int = 1) -> Column:
    """The weight of a node: of its whole path if named, else of its own last name under any parent (given as ('*', ..., name))."""
    out = F.lit(default)
    for path, w in sorted(((p, w) for p, w in weights.items() if len(p) == level), key=lambda x: x[0].count("*"), reverse=True):
        cond = F.lit(True)
        for name, want in zip(LEVELS, path, strict=False):
            if want != "*":
                cond = cond & (F.col(f"_{name}") == want)
        out = F.when(cond, F.lit(w)).otherwise(out)
    return out.cast("decimal(10,0)")


def share_out(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """``children``: parents, name, cap, w, budget (the parent's, on each child). Adds ``own``: the child's part of it."""
    if not parents:
        children, parents = children.withColumn("_root", F.lit(0)), ["_root"]
    group = W.partitionBy(*parents)
    order = group.orderBy((F.col("cap").cast("double") / F.col("w").cast("double")), name)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    df = children.where("w > 0").withColumns({"_c": F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("decimal(26,0)"), "_w": F.sum("w").over(after).cast("decimal(12,0)")})
    df = df.withColumn("_full", F.col("_c") * F.col("w") + F.col("cap") * F.col("_w") <= F.col("budget") * F.col("w"))
    df = df.withColumns({"_left": F.col("budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(group), F.lit(0)), "_open": F.sum(F.when(~F.col("_full"), F.col("w"))).over(group)})
    part = F.floor(F.expr("cast(_left as decimal(26,0)) * w div cast(_open as decimal(12,0))"))
    return df.withColumn("own", F.when(F.col("_full"), F.col("cap")).otherwise(part).cast("decimal(20,0)")).drop("_c", "_w", "_full", "_left", "_open", "_root")


def leaf_budgets(leaves: DataFrame, weights: Weights, share: tuple[int, int], max_epochs: int) -> DataFrame:
    """``leaves``: _domain, _lang, _source, tokens. Adds budget, epochs (whole ones) and rest (tokens of the last epoch)."""
    d, l, s = (f"_{x}" for x in LEVELS)
    whole = W.partitionBy()  # over the domains
    third = leaves.withColumns({"cap": (F.col("tokens") * max_epochs).cast("decimal(20,0)"), "w": weight_of(3, weights)})
    up = (F.sum(F.when(F.col("w") > 0, F.col("cap"))).cast("decimal(20,0)").alias("cap"), F.sum("tokens").cast("decimal(20,0)").alias("tokens"))
    second = third.groupBy(d, l).agg(*up).withColumn("w", weight_of(2, weights))
    first = second.groupBy(d).agg(*up).withColumn("w", weight_of(1, weights))
    # the budget is the target, or all that weights let through if that is less
    target = F.expr(f"cast(sum(tokens) over () * {share[0]} div {share[1]} as decimal(20,0))")
    most = F.sum(F.when(F.col("w") > 0, F.col("cap"))).over(whole)
    first = first.withColumn("budget", F.least(target, most).cast("decimal(20,0)"))
    one = share_out(first.where("cap IS NOT NULL"), [], d).select(d, F.col("own").alias("budget"))
    two = share_out(second.where("cap IS NOT NULL").join(one, d), [d], l).select(d, l, F.col("own").alias("budget"))
    three = share_out(third.join(two, [d, l]), [d, l], s)
    epochs = F.when(F.col("tokens") > 0, F.expr("own div tokens")).otherwise(F.lit(0)).cast("int")
    out = three.select(d, l, s, "tokens", F.col("own").cast("long").alias("budget"), epochs.alias("epochs"))
    return out.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def mix_sources(
    docs: DataFrame, domain: Column, weights: Weights, share: tuple[int, int] = (1, 1), max_epochs: int = 4, seed: int = 17,
    lang: Column | None = None, source: Column | None = None, tokens: Column | None = None, id_col: str = "doc_id",
) -> DataFrame:
    """``docs`` with all columns, once for each epoch they are taken in, and epoch (int), place (string: a source's rows by epoch, then place, are in seeded order) and domain (string).

    ``share``: the budget as a fraction of all tokens."""
    names = [F.coalesce(c.cast("string"), F.lit("")).alias(f"_{n}") for n, c in zip(LEVELS, (domain, F.col("lang") if lang is None else lang, F.col("source") if source is None else source), strict=True)]
    nodes = [f"_{n}" for n in LEVELS]
    count = words(F.col("text")) if tokens is None else tokens
    narrow = written(docs.select(F.col(id_col).alias("_id"), *names, F.coalesce(count, F.lit(0)).cast("long").alias("tokens")), "mix-rows")
    leaves = narrow.groupBy(*nodes).agg(F.sum("tokens").alias("tokens"))
    budgets = written(leaf_budgets(leaves, weights, share, max_epochs), "mix-leaves")
    # where in the last epoch's order each leaf's prefix ends: the range of two digits of the key, then of four
    rows = narrow.join(budgets.select(*nodes, "epochs", "rest"), nodes).withColumn("_key", order_key(seed, F.col("epochs"), F.col("_id"))).withColumn("_before", F.lit(0).cast("long"))
    up_to = W.partitionBy(*nodes).orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow)
    for digits in (2, 4):
        ranged = rows.withColumn("_range", F.substring("_key", 1, digits))
        sums = ranged.groupBy(*nodes, "rest", "_before", "_range").agg(F.sum("tokens").alias("t"))
        over = sums.withColumn("_sum", F.col("_before") + F.sum("t").over(up_to)).where("_sum > rest")
        ends = written(over.groupBy(*nodes).agg(F.min(F.struct("_range", (F.col("_sum") - F.col("t")).alias("_before"))).alias("e")).select(*nodes, "e.*"), f"mix-ends-{digits}")
        rows = written(ranged.drop("_before").join(ends, [*nodes, "_range"]).select(*nodes, "_key", "rest", "tokens", "_before", "_range"), f"mix-ends-rows-{digits}")
    last = rows.groupBy(*nodes, "_key", "rest", "_before").agg(F.sum("tokens").alias("t"))
    in_key = W.partitionBy(*nodes).orderBy("_key").rowsBetween(W.unboundedPreceding, W.currentRow)
    cut = last.withColumn("_sum", F.col("_before") + F.sum("t").over(in_key)).where("_sum <= rest").groupBy(*nodes).agg(F.max("_key").alias("_cut"))
    # without an end the whole order fits; with an end but no key of its range, all ranges before it fit
    cuts = budgets.select(*nodes, "epochs").join(ends, nodes, "left").join(cut, nodes, "left").select(*nodes, "epochs", F.coalesce("_cut", "_range", F.lit("g")).alias("_cut"))
    cuts = written(cuts, "mix-cuts")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(id_col).alias("_id"), *names)
    taken = rows.join(cuts, nodes).withColumn("_in", order_key(seed, F.col("epochs"), F.col("_id")) <= F.col("_cut"))
    times = F.col("epochs") + F.col("_in").cast("int")
    taken = taken.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1))).withColumn("domain", F.col("_domain"))
    return unpacked(taken.withColumn("place", order_key(seed, F.col("epoch"), F.col("_id"))), "epoch", "place", "domain")
