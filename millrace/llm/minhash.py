"""MinHash near-duplicates (operator 10).

Method: a text's set of 5-word shingles is reduced to ``HASHES`` minima under universal hash functions; bands of ``ROWS``
minima are hashed to buckets; texts that share a bucket are candidates, candidates are verified by their signatures (at least ``SCREEN`` of the
minima equal) and then confirmed on their full sets, and documents joined by confirmed links form components, found by alternating large-star and
small-star. At the threshold of 0.75 a pair is missed by all bands with probability (1 - 0.75^4)^32, about 5 in a million, and by the signatures
with about 1 in 10^10; both are the same for every pair, whatever its group's size.

Scale. Texts with equal sets are one class from the start and only its smallest id goes on. A bucket is never
expanded into pairs: each member is linked to the bucket's smallest id, and components of these links are the clusters
within which links are sought, so no pair that shares a bucket can be lost. A cluster of at most ``CLUSTER_DOCS``
documents and ``CLUSTER_SHINGLES`` shingles is confirmed in one task.

A larger one is first split exactly (``split_clusters``): two sets at the threshold share one of the rarest shingles of each, as many as the threshold lets
the other lack, and one more. So documents that have only a template in common part here, whatever buckets chained them. What is still large is confirmed
in rounds over all tasks: every member is compared with a broadcast batch of pivots (together at most ``PIVOT_SHINGLES`` shingles, 32 MB, and their signatures, or one document's
set if that is larger); the next pivots are the members outside
the cluster's largest component, until each of them has been a pivot: one of a cluster at first, then about ``MORE_PIVOTS`` times as many each round, chosen by hash without ordering a cluster, whose links are added to the components so far. A link between two components would have one end outside
the largest, so no link is lost. Clusters of near copies need two or three rounds; else a round disposes of ``PIVOT_SHINGLES`` shingles of pivots, so rounds grow with the
members that share a rare shingle and are still no near-duplicates.

Defined cases: without words (null, empty, blank text) a document has no shingles and is linked with nothing; rows of one id
are one document: what is linked with one of them is linked with all; null ids count as one such id, the smallest; ties can't arise, as a component's name is its
smallest id; a text of any length is hashed 250,000 bytes at a time, and held as its set of distinct shingles, 8 bytes each; an empty table
gives an empty result; other columns pass through ``near_duplicates``, one named like an output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, stars
from .shared import Sieve, keyed, mix, packed, public_id, sieved, unpacked, unzip, written
from .shingles import shingle_sets

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
PERCENT = 75
SCREEN = 0.5  # least share of equal minima for an exact check: over six standard deviations under the threshold
CLUSTER_DOCS, CLUSTER_SHINGLES = 500, 2_000_000
PIVOT_SHINGLES, PIVOT_DOCS = 4_000_000, 50_000
MORE_PIVOTS = 64  # how many times as many pivots of a cluster the next round has
_RNG = np.random.default_rng(75)
_A = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_W = mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 2**64 - 1, np.uint64)
    for a in range(0, len(shingles), 512):
        np.minimum(out, (shingles[a : a + 512, None] * _A + _B).min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    return mix((mix(sig).reshape(BANDS, ROWS) * _W).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold; sizes alone decide many pairs."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum()) if len(b) else 0
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


_SKETCH = pa.schema([("_id", pa.int64()), ("_th", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, d1, d2, bands = [], [], [], []
        for s in shingle_sets(batch.column("_text")):
            n.append(len(s))
            h = xxhash.xxh3_128_intdigest(s.data)
            d1.append((h >> 64) - 2**63 if len(s) else None)
            d2.append((h & (2**64 - 1)) - 2**63 if len(s) else None)
            bands.append(band_keys(signature(s)) if len(s) else None)
        yield pa.record_batch([batch.column("_id"), batch.column("_th"), *(pa.array(c, f.type) for c, f in zip((n, d1, d2, bands), list(_SKETCH)[2:], strict=True))], schema=_SKETCH)


def short(sig: np.ndarray) -> np.ndarray:
    """Minima cut to 16 bits for verification: equal ones stay equal, so no candidate is lost by it."""
    return sig.astype(np.uint16)


def alike(sigs: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Which rows of ``sigs`` the signature verifies as candidates of ``sig``, likeliest first."""
    same = (sigs == sig).sum(axis=1)
    order = np.argsort(-same, kind="stable")
    return order[same[order] >= SCREEN * HASHES]


def links_within(ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """(id, root) for every id whose component among these sets, by confirmed links, has a smaller one.

    A set is verified by signature against those before it, and checked on the full sets where they aren't yet in its component."""
    sigs = np.stack([short(signature(s)) for s in sets])
    group = np.arange(len(ids))
    for k in range(1, len(ids)):
        for j in alike(sigs[:k], sigs[k]).tolist():
            if group[j] != group[k] and linked(sets[j], sets[k]):
                group[group == group[k]] = group[j]
                if (group[:k] == group[k]).all():
                    break
    low: dict[int, int] = {}
    for g, i in zip(group.tolist(), ids, strict=True):
        low[g] = min(i, low.get(g, i))
    return [(i, low[g]) for g, i in zip(group.tolist(), ids, strict=True) if i != low[g]]


def _texts(batch: pa.RecordBatch) -> pa.Array:
    return pa.array([unzip(z) for z in batch.column("zipped").to_pylist()], pa.binary())


def _wanted(own: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` with their texts, zipped: a sieve keeps most other texts out of the shuffle."""
    return sieved(own, Sieve(nodes.select("_id", "_th"))).join(nodes, ["_id", "_th"]).dropDuplicates(["_id", "_th"])


def _sets_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    lists = batch.column("shingles")
    every, offs = lists.flatten().to_numpy().view(np.uint64), (np.asarray(lists.offsets) - lists.offsets[0].as_py()).tolist()
    return (every[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by cluster: the links of each cluster."""
    cluster, ids, sets = None, [], []

    def done() -> pa.RecordBatch:
        got = links_within(ids, sets) if len(ids) > 1 else []
        return pa.record_batch([pa.array([p[k] for p in got], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        found = _sets_of(batch) if "shingles" in batch.schema.names else shingle_sets(_texts(batch))
        for c, i, s in zip(batch.column("cluster").to_pylist(), batch.column("_id").to_pylist(), found, strict=True):
            if c != cluster:
                if len(ids) > 1:
                    yield done()
                cluster, ids, sets = c, [], []
            ids.append(i)
            sets.append(s)
    if len(ids) > 1:
        yield done()


def _in_one_task(members: DataFrame) -> DataFrame:
    """The links of whole clusters: each in one task."""
    return members.repartition("cluster").sortWithinPartitions("cluster", "_id").mapInArrow(_confirm, "a long, b long")


def with_fit(nodes: DataFrame) -> DataFrame:
    """``nodes`` (cluster, _id, n) with fits: whether the whole cluster goes into one task."""
    sizes = nodes.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    fits = (F.col("docs") <= CLUSTER_DOCS) & (F.col("shingles") <= CLUSTER_SHINGLES)
    return nodes.join(sizes.select("cluster", fits.alias("fits")), "cluster")


def split_clusters(members: DataFrame) -> DataFrame:
    """(cluster, _id, n, shingles) by smaller clusters: what shares one of the rarest shingles stays together, what shares none is dropped.

    A set of n shingles at the threshold with another lacks at most n - ceil(0.75 n) of them there, so one of its n - ceil(0.75 n) + 1 rarest
    is common to both; by one order for all, the first common shingle of both is among the rarest of both."""
    tokens = members.select("cluster", "_id", F.explode("shingles").alias("t"))
    often = written(tokens.groupBy("cluster", "t").agg(F.count("*").alias("f")).where("f > 1"), "shingle-counts")
    ranked = tokens.join(often, ["cluster", "t"], "left").groupBy("cluster", "_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(1)).alias("f"), "t"))).alias("s"))
    most = F.size("s") - F.ceil(F.size("s") * PERCENT / 100).cast("int") + 1
    rare = written(ranked.select("cluster", "_id", F.explode(F.slice("s", F.lit(1), most)).alias("x")).where("x.f > 1").select("cluster", F.col("x.t").alias("t"), "_id"), "rare-shingles")
    low = written(rare.groupBy("cluster", "t").agg(F.min("_id").alias("low")), "rare-least")
    roots = components(stars(rare.join(low, ["cluster", "t"]).where("_id <> low").select("_id", "low")))
    named = roots.select(F.col("node").alias("_id"), F.col("root").alias("cluster")).union(roots.select(F.col("root"), "root").distinct())
    return written(members.select("_id", "shingles", F.size("shingles").alias("n")).join(named, "_id").select("cluster", "_id", "n", "shingles"), "split")


class Pivots:
    """Some sets with their signatures, to be compared with another set all at once."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]) -> None:
        self.ids, self.sets = ids, sets
        self.sigs = np.stack([short(signature(s)) for s in sets])

    def linked(self, s: np.ndarray) -> list[int]:
        return [self.ids[j] for j in alike(self.sigs, short(signature(s))).tolist() if linked(self.sets[j], s)]


class Joined:
    """Which ids have been joined so far, by union-find."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, i: int) -> int:
        while (j := self.up.setdefault(i, i)) != i:
            self.up[i] = i = self.up.setdefault(j, j)
        return i

    def join(self, a: int, b: int) -> bool:
        """Join two ids; whether they weren't before."""
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b


def _in_rounds(members: DataFrame) -> DataFrame:
    """(id, root) within clusters that don't fit one task. ``members``: cluster, _id, n, shingles (array<long>), already written."""
    spark = members.sparkSession
    sizes = members.select("cluster", "_id", "n")
    done: DataFrame | None = None  # _id of all pivots so far
    links: DataFrame | None = None  # the components so far and what the last pivots added
    each = 1  # pivots of one cluster: few at first, as they leave few others outside the largest component where copies are many
    while True:
        if links is None:  # nothing is known: the smallest id of each cluster goes first
            todo = sizes.groupBy("cluster").agg(F.min_by(F.struct("_id", "n"), "_id").alias("p")).select("cluster", "p.*")
        else:
            roots = components(links)
            label = sizes.join(roots, sizes["_id"] == roots["node"], "left").select("cluster", "_id", "n", F.coalesce("root", "_id").alias("root"))
            count = label.groupBy("cluster", "root").agg(F.count("*").alias("c"))
            largest = count.groupBy("cluster").agg(F.max_by("root", F.struct("c", "root")).alias("top"))
            todo = label.join(largest, "cluster").where("root <> top").select("cluster", "_id", "n").join(done, "_id", "left_anti")
        # as many pivots as the broadcast's bound allows, at least one; a cluster's own are its smallest id and about ``each`` others. Their
        # turns are a cluster's size times an id's share of the hash range, about the places they had in a random order, so no cluster is ordered as a whole
        todo = written(todo.select("cluster", "_id", "n"), "todo")
        left = todo.groupBy("cluster").agg(F.count("*").alias("c"), F.min("_id").alias("first"))
        share = F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(2**31)) / 2**31
        turn = F.when(F.col("_id") == F.col("first"), -1.0).otherwise(share * F.col("c"))
        todo = todo.join(left, "cluster").select("_id", "n", turn.alias("turn")).where(F.col("turn") < each)
        few, each = todo.orderBy("turn", "_id").limit(PIVOT_DOCS).collect(), min(MORE_PIVOTS * each, PIVOT_DOCS)
        total, batch = 0, []
        for r in few:
            if batch and total + r["n"] > PIVOT_SHINGLES:
                break
            batch.append(r["_id"])
            total += r["n"]
        if not batch:
            return roots if links is not None else spark.createDataFrame([], "a long, b long")
        tried = written(spark.createDataFrame([(i,) for i in batch], "_id long"), "tried")
        chosen = members.join(tried, "_id").select("cluster", "_id", "shingles").toArrow()
        by: dict[int, list] = {}
        for piece in chosen.to_batches():
            for c, i, x in zip(piece.column("cluster").to_pylist(), piece.column("_id").to_pylist(), _sets_of(piece), strict=True):
                by.setdefault(c, []).append((i, x))
        pivots = spark.sparkContext.broadcast({c: Pivots([i for i, _ in x], [s for _, s in x]) for c, x in by.items()})

        def run(batches: Iterator[pa.RecordBatch], pivots=pivots) -> Iterator[pa.RecordBatch]:
            joined = Joined()  # a task tells only links that join what its links before haven't
            for b in batches:
                out: tuple[list, list] = ([], [])
                for c, i, s in zip(b.column("cluster").to_pylist(), b.column("_id").to_pylist(), _sets_of(b), strict=True):
                    for p in pivots.value[c].linked(s) if c in pivots.value else ():
                        if joined.join(p, i):
                            out[0].append(p)
                            out[1].append(i)
                yield pa.record_batch([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

        new = members.select("cluster", "_id", "shingles").mapInArrow(run, "a long, b long")
        links = written(new if links is None else roots.union(new), "links")
        done = tried if done is None else written(done.union(tried), "pivots")


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 100):
            part = b.slice(k, 100)
            sets = [s.view(np.int64) for s in shingle_sets(_texts(part))]
            yield pa.record_batch([part.column("cluster"), part.column("_id"), pa.array(sets, pa.list_(pa.int64()))], names=["cluster", "_id", "shingles"])


def confirmed(texts: DataFrame) -> DataFrame:
    """(a, b): links whose components are those of all confirmed links. ``texts``: cluster, _id, fits, zipped."""
    links = _in_one_task(texts.where("fits").select("cluster", "_id", "zipped"))
    large = texts.where("NOT fits").select("cluster", "_id", "zipped")
    if texts.select("fits").where("NOT fits").isEmpty():
        return links
    split = split_clusters(written(large.mapInArrow(_with_sets, "cluster long, _id long, shingles array<long>"), "members"))
    part = with_fit(split)
    links = links.union(_in_one_task(part.where("fits").select("cluster", "_id", "shingles")))
    rest = written(part.where("NOT fits").drop("fits"), "large-members")
    return links if rest.isEmpty() else links.union(_in_rounds(rest))


def labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _th, n_shingles, component): one row per input row; component is the smallest id reachable."""
    own = keyed(docs, id_col, text_col)
    sketch = written(own.mapInArrow(_sketch, "_id long, _th long, n long, d1 long, d2 long, bands array<long>"), "sketch")
    ink = sketch.where(F.col("d1").isNotNull())
    classes = written(ink.groupBy("d1", "d2").agg(F.min_by(F.struct("_id", "_th", "bands", "n"), F.struct("_id", "_th")).alias("r")).select("d1", "d2", "r.*"), "classes")
    # buckets: each member is linked to the smallest id there
    keys = classes.select("_id", F.explode("bands").alias("k"))
    # written, so that the join reads both sides from a shuffle and a hot bucket's partition can be split
    lows = written(keys.groupBy("k").agg(F.min("_id").alias("low"), F.count("*").alias("c")).where("c > 1").select("k", "low"), "buckets")
    roots = components(stars(keys.join(lows, "k").where("_id <> low").select("_id", "low")))
    nodes = roots.select(F.col("root").alias("cluster"), F.col("node").alias("_id"))
    nodes = nodes.union(nodes.select("cluster", F.col("cluster").alias("_id")).distinct())
    nodes = written(with_fit(nodes.join(classes.select("_id", "_th", "n"), "_id")).select("cluster", "_id", "_th", "fits"), "clusters")
    links = confirmed(written(_wanted(own, nodes), "cluster-texts"))
    # one id with several texts: its classes belong together
    member = written(ink.select("_id", "_th", "d1", "d2", "n").join(classes.select("d1", "d2", F.col("_id").alias("rep")), ["d1", "d2"]).select("_id", "_th", "n", "rep"), "members")
    split = written(member.groupBy("_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("_id", "low"), "split-ids")
    if not split.isEmpty():
        links = links.union(member.join(split, "_id").where("rep <> low").select("rep", "low"))
    found = components(links)
    labelled = member.join(found, member["rep"] == found["node"], "left").select("_id", "_th", "n", F.coalesce("root", "rep").alias("component"))
    blank = sketch.where(F.col("d1").isNull()).select("_id", "_th", "n", F.col("_id").alias("component"))
    return labelled.union(blank).withColumnRenamed("n", "n_shingles")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all columns, n_shingles (long), component_id (like the id) and kept (boolean)."""
    found = labels(docs, id_col, text_col).dropDuplicates(["_id", "_th"])
    df = packed(docs, id_col, text_col).join(found, ["_id", "_th"])
    df = df.withColumn("component_id", public_id("component")).withColumn("kept", F.col("_id") == F.col("component"))
    return unpacked(df, "n_shingles", "component_id", "kept")
