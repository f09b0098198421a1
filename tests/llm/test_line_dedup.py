"""Line dedup against a plain version, over many partitions and with hot keys."""

import random
from collections import defaultdict

from millrace.llm import line_dedup

SCHEMA = "doc_id long, text string, keep string, _id int, n_lines int"


def plain(rows, min_chars=40, min_docs=5):
    docs, top = defaultdict(set), {}
    for i, text in rows:
        i = -(2**63) if i is None else i
        for line in (text or "").split("\n"):
            key = line_dedup.line_key(line)
            if len(key) >= min_chars:
                docs[key].add(i)
                top[key] = max(top.get(key, i), i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        j = -(2**63) if i is None else i
        kept = [x for x in lines if not (len(docs[k := line_dedup.line_key(x)]) >= min_docs and top[k] != j)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def check(spark, rows, parts=7):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame([(i, t, "x", 3, 4) for i, t in rows], SCHEMA)
        got = line_dedup.dedup_lines(df)
        assert set(got.columns) == {"doc_id", "text", "keep", "_id", "n_lines", "n_dropped", "kept_text"}
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()), key=str) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_random_tables(spark):
    rng = random.Random(3)
    lines = [f"{k:03d} " + "word " * 9 for k in range(40)]
    for parts in (1, 7, 40):
        rows = []
        for i in range(300):
            own = [rng.choice(lines) if rng.random() < 0.5 else f"line {i} {rng.random()} {'pad ' * 10}" for _ in range(rng.randrange(6))]
            own += [lines[0].upper() + "\t "] * (rng.random() < 0.6)
            rows.append((i, "\n".join(own)))
        check(spark, rows, parts)


def test_one_key_over_all_partitions(spark):
    check(spark, [(i, "the same line in every document, long enough to count\nown %d" % i) for i in range(500)], 23)


def test_odd_rows(spark):
    long = "é" * 40
    rows = [(None, long), (None, long), (1, None), (2, ""), (3, f"{long}\n{long}"), (3, f"{long}\n{long}"), (3, f"{long}\nother"), (4, long.upper()), (5, f"  {long}\r"), (6, long), (7, long), (8, "é" * 39)] + [(9 + k, "é" * 39) for k in range(6)]
    check(spark, rows)
    check(spark, [(1, "\n\n\n" + "long text " * 200_000)])


def test_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_bitmaps_carry_no_text(spark):
    df = spark.createDataFrame([(i, "a line that stands in all of the ten documents here\nx") for i in range(10)], "doc_id long, text string")
    bits = line_dedup.line_bitmaps(df).collect()
    assert len(bits) == 9 and all(line_dedup.unpack(bytes(b.keep), b.n_lines).tolist() == [False, True] for b in bits)
