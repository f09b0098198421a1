"""Quality rules (operator 9): learned decision lists over text statistics. Native: DataFrame functions only.

Method: sequential covering. Rules that reject are learned one after the other from labelled statistics: a conjunction of
thresholds is grown greedily by information gain on two thirds of the labelled rows not yet covered, pruned from its end on the
other third, and kept if it is precise enough on both; the rows it covers are taken out and the next one is learned. The
list becomes one ordered CASE expression that Spark evaluates next to the statistics.

Scale. Statistics are expressions over one row, with no shuffle and no Python: repeated 3-word windows are found by sorting
(hash, position) pairs within the row and comparing neighbours, n log n in the words of a document. Learning sees at most
``sample`` labelled rows (those of smallest id hash), chosen by a top-k and joined back by broadcast: the bound is that
parameter, whatever the size of the tables.

Defined cases: null or empty text has all statistics 0 and fails the base rule; without labels, or with labels of one
kind only, the list is empty and only the base rule rejects; labels that are null are not used; an id that occurs
twice is scored twice; other columns pass through, one named like an output is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import row_id, unpacked

BLANK = " \t\n\x0b\x0c\r"
BLANKS = r"[ \t-\r]+"
SYMBOLS, UPPER, SHOUT = r"[#*$%&|<>]", "[A-Z]", "[!?]"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What rules may test, as functions of the statistics.
FEATURES = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "shout_share"]


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(_row, the five STATS as long, the FEATURES as double): one row per input row, no shuffle."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), text.alias("_text"))
    # without blanks at its ends a text splits into words alone; an empty text has none
    inner = F.btrim("_text", F.lit(BLANK))
    split = F.when(inner != "", F.split(inner, BLANKS)).otherwise(F.array().cast("array<string>"))
    df = df.select("*", split.alias("_words"), F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "").alias("_lines"))
    windows = F.slice(F.transform("_words", lambda x, i: F.xxhash64(x, F.get("_words", i + 1), F.get("_words", i + 2))), F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0)))
    df = df.select(
        "_row",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        count_of(F.col("_text"), SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").alias("_n_lines"),
        count_of(F.col("_text"), UPPER).alias("_upper"),
        count_of(F.col("_text"), SHOUT).alias("_shout"),
        windows.alias("_win"),
    )
    # windows found twice: neighbours with equal hashes once sorted; only texts that have any are sorted
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(empty))
    twice = F.transform("_sorted", lambda e, j: F.when((F.get("_sorted", j - 1)["h"] == e["h"]) | (F.get("_sorted", j + 1)["h"] == e["h"]), e["i"]))
    df = df.withColumn("_at", F.sort_array(F.filter(twice, lambda i: i.isNotNull()))).drop("_sorted", "_win")
    covered = F.transform("_at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - p, F.lit(3))))
    df = df.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_at")
    # A filter on a statistic must not be pushed below: it would put whole expressions into the lambdas that read them.
    # Spark moves no filter past a column that isn't deterministic, and this condition is one that always holds.
    fence = F.monotonically_increasing_id() >= 0
    return df.select(
        "_row", *(F.when(fence, F.col(c)).alias(c) for c in STATS),
        share(F.col("word_chars"), F.col("n_words")).alias("mean_word"),
        share(F.col("n_symbols"), F.col("word_chars")).alias("symbol_share"),
        share(F.col("n_dup_lines"), F.col("_n_lines")).alias("dup_line_share"),
        share(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_share"),
        share(F.col("_upper"), F.col("word_chars")).alias("upper_share"),
        share(F.col("_shout"), F.col("word_chars")).alias("shout_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    at: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] >= self.at if self.above else row[self.feature] <= self.at

    def column(self) -> Column:
        c = F.col(self.feature).cast("double")
        return c >= F.lit(self.at) if self.above else c <= F.lit(self.at)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.at:.6g}"


Rule = tuple[Test, ...]


def _covers(rule: Rule, row: dict) -> bool:
    return all(t.holds(row) for t in rule)


def _best_test(rows: list[tuple[dict, bool]]) -> Test | None:
    """The threshold with the largest FOIL gain for the bad rows; thresholds lie midway between neighbouring values."""
    bad = sum(b for _, b in rows)
    start = math.log2(bad / len(rows))
    best, gain = None, 1e-9
    for f in FEATURES:
        order = sorted((float(r[f]), b) for r, b in rows)
        p = n = 0
        for k in range(len(order) - 1):
            p, n = p + order[k][1], n + (not order[k][1])
            if order[k][0] == order[k + 1][0]:
                continue
            at = (order[k][0] + order[k + 1][0]) / 2
            for above, pos, total in ((False, p, p + n), (True, bad - p, len(rows) - p - n)):
                if pos and (g := pos * (math.log2(pos / total) - start)) > gain:
                    best, gain = Test(f, above, at), g
    return best


def _value(rule: Rule, rows: list[tuple[dict, bool]]) -> tuple[float, int]:
    hit = [b for r, b in rows if _covers(rule, r)]
    return (sum(hit) / len(hit) if hit else 0.0), len(hit)


def learn(rows: list[dict], precision: float = 0.9, min_cover: int = 5, max_rules: int = 12, max_tests: int = 4) -> list[Rule]:
    """An ordered list of rejecting rules from rows of FEATURES and ``bad``. Rows are dealt to growing and pruning in turn."""
    left = [(r, bool(r["bad"])) for r in rows]
    rules: list[Rule] = []
    while len(rules) < max_rules and sum(b for _, b in left) >= min_cover:
        grow = [x for k, x in enumerate(left) if k % 3 < 2]
        prune = [x for k, x in enumerate(left) if k % 3 == 2]
        rule: Rule = ()
        covered = grow
        while len(rule) < max_tests and any(b for _, b in covered) and not all(b for _, b in covered) and (t := _best_test(covered)):
            rule += (t,)
            covered = [x for x in covered if t.holds(x[0])]
        if not rule:
            break
        # prune from the end: the shortest prefix that is best on rows not used to grow it
        options = [rule[:k] for k in range(1, len(rule) + 1)]
        rule = max(options, key=lambda r: ((v := _value(r, prune))[0] * v[1] - (1 - v[0]) * v[1] * precision / (1 - precision), -len(r)))
        p_grow, _ = _value(rule, grow)
        p_prune, n_prune = _value(rule, prune)
        p_all, n_all = _value(rule, left)
        if n_all < min_cover or p_all < precision or (n_prune and p_prune < precision):
            break
        rules.append(rule)
        left = [x for x in left if not _covers(rule, x[0])]
    return rules


def labelled(docs: DataFrame, labels: DataFrame, sample: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[dict]:
    """At most ``sample`` labelled rows' FEATURES and ``bad``, in an order by id hash; rows that the base rule rejects are left out."""
    few = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(row_id(id_col).alias("_id"), (F.col(label_col) == 0).alias("_bad"))
    few = few.withColumn("_order", F.xxhash64("_id", F.lit(9))).orderBy("_order", "_id", "_bad").limit(sample)
    own = docs.select(row_id(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(few), "_id")
    found = statistics(own, "_t").select(*FEATURES, (~base_failed()).alias("_judged"), "_row._bad", "_row._order", "_row._id").collect()
    found.sort(key=lambda r: (r["_order"], r["_id"], r["_bad"], *(r[f] for f in FEATURES)))
    return [{f: float(r[f]) for f in FEATURES} | {"bad": r["_bad"]} for r in found if r["_judged"]]


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional: the number of the first rule that holds (from 1), else 0."""
    out = None
    for k, rule in enumerate(rules, 1):
        cond = rule[0].column()
        for t in rule[1:]:
            cond = cond & t.column()
        out = F.when(cond, F.lit(k)) if out is None else out.when(cond, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with all columns, the five STATS, base_failed, rule (first rejecting rule, 0 if none) and kept."""
    df = statistics(docs, text_col).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return unpacked(df.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), *STATS, "base_failed", "rule", "kept")
