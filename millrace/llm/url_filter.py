"""URL filters (operator 6): rules by host and path, and a character language-model ratio for the rest.

Method: two Markov models of variable order over the characters of the whole URL (query and fragment too; A-Z of scheme and host
lower-cased), one of accepted and one of rejected URLs.
Each order's n-gram counts are smoothed with the next lower order's estimate (the estimate of order k is
(count + STRENGTH * lower estimate) / (context count + STRENGTH)), down to a uniform one. A URL's score is the difference of the two
log-likelihoods divided by its length; it is blocked above a threshold calibrated on labelled URLs.

Which URLs are accepted and rejected examples is a parameter (``kind``: any Column of 0, 1 or null). The default, ``examples``, has no word list: what a
rule blocks or allows is an example of that kind, and a page that no rule decides is one by its own text (``page_kind``: rejected where symbols take
``JUNK_SHARE`` of it or it has under ``LEAST_WORDS`` words), if the caller has one. The counts cover every example in the table.

Cross-fitting: hosts are dealt to ``FOLDS`` folds by hash, and a URL is scored by the counts of the other folds. So no URL is judged by its own
host's label, which a table of n-grams would only recite, and the threshold is calibrated on scores of hosts not counted: on examples that no rule
decides where there are ``LEAST_EXAMPLES`` of both kinds, else on all.

Scale. Counts are exact: the longest n-gram that ends at each character is counted per batch in numpy and summed by Spark, shorter ones and
contexts are sums over it. The table of counts is written and grows with the distinct n-grams; nothing is collected but the
totals and histograms of ``BINS`` counts for the threshold. To score, the distinct n-grams of the texts look up their
counts by a join, and each character of a distinct text then looks up its n-gram's ratio by another; Spark broadcasts these tables where they are
small. Ratios are summed as whole numbers of 1 / ``UNIT``, so scores don't depend on the order of rows. Texts are told apart by two 64-bit hashes. Rules
are Column expressions.

Defined cases: null URLs and URLs without ``://`` have empty host and path and get the verdict of an empty string, allow; without rejected
or accepted examples the method allows everything; null or empty page text says nothing; repeated rows are judged row by row, and each counts as an example; very long URLs are read whole; ties
of thresholds go to the middle of the widest best range; other columns pass
through, one named like an output is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import flat, unpacked, written

ORDERS = 5  # longest n-gram
LENGTH, CONTEXT = 8 * ORDERS, 1 << 8 * ORDERS + 3  # bits of a key: the bytes, their number, whether it is a context
STRENGTH = 4.0
UNIT = 1 << 32
BINS, LOWEST, HIGHEST = 400, -5.0, 5.0
FOLDS = 4
JUNK_SHARE, LEAST_WORDS, LEAST_EXAMPLES = 0.02, 20, 20
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    before = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.substring_index(before, "/", 1)
    return F.translate(host, UPPER, LOWER), F.substring(before, F.length(host) + 1, F.length(before))


def whole(url: Column, host: Column) -> Column:
    """The URL with A-Z of scheme and host lower-cased; empty without ``://``."""
    at = F.instr(url, "://")
    head = at + 2 + F.length(host)
    text = F.concat(F.translate(F.substring(url, F.lit(1), head), UPPER, LOWER), F.substring(url, head + 1, F.length(url)))
    return F.when(F.coalesce(at, F.lit(0)) > 0, text).otherwise(F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the last to fit is the longest
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def page_kind(html: Column) -> Column:
    """What a page's own text says of it: 1 where it is junk, 0 where it reads as text, null without any."""
    shown = F.regexp_replace(F.coalesce(html.cast("string"), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    shown = F.regexp_replace(shown, "&(amp|lt|gt);", "&")

    def kind(text: Column) -> Column:  # a lambda's variable, so that the markup is taken out once
        ink = F.char_length(F.regexp_replace(text, r"[ \t-\r]+", ""))
        junk = (F.regexp_count(text, F.lit(r"[#*$%&|<>]")) >= JUNK_SHARE * ink) | (F.regexp_count(text, F.lit(r"[^ \t-\r]+")) < LEAST_WORDS)
        return F.when(ink > 0, junk.cast("int"))

    return F.get(F.transform(F.array(shown), kind), 0)


def examples(host: Column, ruled: Column, page: Column) -> Column:
    """1 for rejected, 0 for accepted, null for neither: by the rule's verdict, else by what the page's text says."""
    return F.when(host == "", F.lit(None)).when(ruled == "block", F.lit(1)).when(ruled == "allow", F.lit(0)).otherwise(page).cast("int")


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of texts laid end to end, each closed by an end mark: the longest n-gram that ends at each character, and the text it belongs to.

    An n-gram is the number of its up to ORDERS bytes, the last one lowest, with its length from bit ``LENGTH`` on, so no two are alike."""
    data, offs = flat(texts)
    size = np.diff(offs) + 1
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size)), size)
    s = np.zeros(int(size.sum()), np.int64)  # 0 is the end mark; a NUL in a text counts as one
    inner = np.arange(len(s)) - first[owner]
    s[inner < size[owner] - 1] = data
    out = np.minimum(inner + 1, ORDERS) << LENGTH
    for j in range(ORDERS):
        at = np.flatnonzero(inner >= j)
        out[at] |= s[at - j] << (8 * j)
    return out, owner


def keys(context: bool, gram: str = "gram") -> list[Column]:
    """Of an n-gram, for orders 1 to ORDERS: its end of that order, or that end's context; null where it is shorter."""
    out = []
    for k in range(1, ORDERS + 1):
        end = F.col(gram).bitwiseAND(F.lit((1 << 8 * k) - 1))
        key = F.shiftright(end, 8) + F.lit(CONTEXT + (k - 1 << LENGTH)) if context else end + F.lit(k << LENGTH)
        out.append(F.when(F.shiftright(gram, LENGTH) >= k, key))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, owner = grams(batch.column("text"))
        kind, fold = (batch.column(c).to_numpy()[owner] for c in ("kind", "fold"))
        every, at = np.unique(found, return_inverse=True)
        own = np.unique(at * 2 * FOLDS + fold * 2 + kind, return_counts=True)
        yield pa.record_batch([pa.array(every[own[0] // (2 * FOLDS)]), pa.array(own[0] % (2 * FOLDS)), pa.array(own[1])], names=["gram", "slot", "n"])


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, owner = grams(batch.column("text"))
        fold = batch.column("fold").to_numpy()[owner]
        for f in np.unique(fold):
            own = np.unique(found[fold == f])
            yield pa.record_batch([pa.array(own), pa.array(np.full(len(own), f))], names=["gram", "fold"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, owner = grams(batch.column("text"))
        yield pa.record_batch([*(pa.array(batch.column(c).to_numpy()[owner]) for c in ("_h1", "_h2", "fold")), pa.array(found)], names=["_h1", "_h2", "fold", "gram"])


SLOTS = [f"n{t}_{f}" for f in range(FOLDS) for t in (0, 1)]  # in the order of fold * 2 + kind
WHOLE = FOLDS  # the fold of texts that are scored by all counts


@dataclass
class Model:
    """Counts (key, one column of SLOTS a fold and kind) of every n-gram and context, the characters of each slot, and the calibrated threshold."""

    counts: DataFrame
    totals: tuple[int, ...]
    threshold: float = np.inf

    def ratios(self, needed: DataFrame) -> DataFrame:
        """(gram, fold, ratio) of distinct n-grams: log-likelihood of the last character by the other folds' counts, rejected minus accepted, in units of 1 / ``UNIT``."""
        own = [*keys(False), *keys(True)[1:]]  # all contexts of order 1 are the same
        looked = needed.select("gram", "fold", F.posexplode(F.array(*own)).alias("at", "key")).where("key IS NOT NULL").join(self.counts, "key", "left")
        others = [sum((F.when(F.col("fold") != f, F.col(f"n{t}_{f}")).otherwise(0) for f in range(FOLDS)), F.lit(0)) for t in (0, 1)]
        n = [F.coalesce(F.sum(F.when(F.col("at") == i, others[t])), F.lit(0)).alias(f"c{t}_{i}") for i in range(len(own)) for t in (0, 1)]
        logs = []
        for t in (0, 1):
            p = F.lit(1 / 256)
            total = F.lit(sum(self.totals[t::2])) - F.coalesce(F.get(F.array(*map(F.lit, self.totals[t::2])), F.col("fold").cast("int")), F.lit(0))
            for k in range(ORDERS):  # an order that the n-gram is too short for counts nothing and leaves p as it is
                context = F.col(f"c{t}_{ORDERS + k - 1}") if k else total
                p = (F.col(f"c{t}_{k}") + F.lit(STRENGTH) * p) / (context + F.lit(STRENGTH))
            logs.append(F.log(p))
        return looked.groupBy("gram", "fold").agg(*n).select("gram", "fold", F.round((logs[1] - logs[0]) * UNIT).cast("long").alias("ratio"))

    def scored(self, rows: DataFrame, text: str = "text", fold: str = "fold") -> DataFrame:
        """``rows`` and score: length-normalised log-likelihood of ``text`` (not null), rejected minus accepted, without the counts of the row's ``fold``."""
        rows = rows.withColumn("_h1", F.xxhash64(text)).withColumn("_h2", F.xxhash64(F.lit(7), text))
        texts = rows.select(F.col(text).alias("text"), F.col(fold).cast("long").alias("fold"), "_h1", "_h2").distinct()
        ratios = written(self.ratios(texts.select("text", "fold").mapInArrow(_distinct, "gram long, fold long").distinct()), "url-ratios")
        places = texts.mapInArrow(_places, "_h1 long, _h2 long, fold long, gram long").join(ratios, ["gram", "fold"])
        score = (F.sum("ratio") / F.count("ratio") / UNIT).alias("score")
        found = written(places.groupBy("_h1", "_h2", F.col("fold").alias("_f")).agg(score), "url-scores")
        return rows.join(found, (rows["_h1"] == found["_h1"]) & (rows["_h2"] == found["_h2"]) & (rows[fold] == found["_f"]), "left").drop("_h1", "_h2", "_f")

    def scores(self, texts: pa.Array, fold: int = WHOLE) -> np.ndarray:
        """Scores of a few texts, by all counts or by those of the other folds."""
        rows = self.counts.sparkSession.createDataFrame(pa.table({"at": np.arange(len(texts)), "text": texts, "fold": np.full(len(texts), fold)}))
        return self.scored(rows).select("at", "score").toArrow().sort_by("at").column("score").to_numpy()


def best_bin(accepted: np.ndarray, rejected: np.ndarray) -> float:
    """Of histograms of scores, the cut (in bins) of least error, where a lost good page weighs twice: the middle of the widest best range."""
    above = np.append(accepted[::-1].cumsum()[::-1], 0) / max(1, accepted.sum())
    below = np.append(0, rejected.cumsum()) / max(1, rejected.sum())
    wrong = 2 * above + below
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    widest = max(runs, key=len)
    return float(widest[0] + widest[-1]) / 2


def fit(urls: DataFrame) -> Model | None:
    """``urls``: text (string), kind (0 accepted, 1 rejected), fold (0 to FOLDS - 1), ruled (boolean: a rule decides it anyway). None without both kinds."""
    urls = urls.select("text", F.col("kind").cast("long").alias("kind"), F.col("fold").cast("long").alias("fold"), "ruled")
    slot = F.col("slot")
    found = urls.select("text", "kind", "fold").mapInArrow(_count, "gram long, slot long, n long")
    longest = found.groupBy("gram").agg(*(F.coalesce(F.sum(F.when(slot == i, F.col("n"))), F.lit(0)).alias(c) for i, c in enumerate(SLOTS)))
    every = longest.select(F.explode(F.array_compact(F.array(*keys(False), *keys(True)))).alias("key"), *SLOTS)
    counts = written(every.groupBy("key").agg(*(F.sum(c).alias(c) for c in SLOTS)), "url-counts")
    one = counts.where(F.col("key") == CONTEXT).first()
    totals = tuple(one[c] for c in SLOTS) if one else ()
    if not sum(totals[::2]) or not sum(totals[1::2]):
        return None
    model = Model(counts, totals)
    at = ((F.col("score") - LOWEST) / (HIGHEST - LOWEST) * BINS).cast("long")
    h = np.zeros((2, 2, BINS))
    for r in model.scored(urls).groupBy("ruled", "kind", F.greatest(F.lit(0), F.least(F.lit(BINS - 1), at)).alias("at")).count().collect():
        h[int(r["ruled"]), r["kind"], r["at"]] = r["count"]
    free = h[0] if h[0].sum(axis=1).min() >= LEAST_EXAMPLES else h.sum(axis=0)
    model.threshold = LOWEST + (HIGHEST - LOWEST) * best_bin(*free) / BINS
    return model


def fold_of(host: Column) -> Column:
    return F.pmod(F.xxhash64(host, F.lit(6)), F.lit(FOLDS))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, page: Column | None = None, kind: Column | None = None, url_col: str = "url") -> DataFrame:
    """``pages`` with all columns, host, path, rule, score (double) and verdict.

    ``page``: what the page's own text says (as ``page_kind``), a Column over ``pages``. ``kind``: labels to use instead of ``examples``, likewise."""
    own = kind if kind is not None else page if page is not None else F.lit(None)
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("_row"), F.col(url_col).cast("string").alias("_url"), own.cast("int").alias("_kind"))
    host, path = host_path(F.col("_url"))
    rows = rows.select("_row", "_url", "_kind", host.alias("host"), path.alias("path"))
    rule, ruled = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("_row", "_kind", "host", "path", rule.alias("rule"), ruled.alias("_ruled"), whole(F.col("_url"), F.col("host")).alias("_text"), fold_of(F.col("host")).alias("_fold"))
    label = F.col("_kind") if kind is not None else examples(F.col("host"), F.col("_ruled"), F.col("_kind"))
    known = rows.select(F.col("_text").alias("text"), label.alias("kind"), F.col("_fold").alias("fold"), F.col("_ruled").isNotNull().alias("ruled")).where("kind IS NOT NULL")
    model = fit(written(known, "url-examples"))
    found = model.scored(rows.drop("_kind"), "_text", "_fold") if model else rows.withColumn("score", F.lit(0.0))
    blocked = (F.col("score") > F.lit(model.threshold)) & (F.col("host") != "") if model else F.lit(False)
    return unpacked(found.withColumn("verdict", F.coalesce("_ruled", F.when(blocked, "block").otherwise("allow"))), "host", "path", "rule", "score", "verdict")
