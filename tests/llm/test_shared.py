"""Rolling hashes, flat views, the sieve, and shingle sets over blocks."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import lz_fingerprint, shared, shingles, toxicity


@given(st.binary(max_size=60), st.data())
@settings(max_examples=150, deadline=None)
def test_equal_slices_have_equal_hashes(data, draw):
    own = np.frombuffer(data + data, np.uint8)
    r = shared.Rolling(own, shared.BYTE_CODES)
    n = len(data)
    a = draw.draw(st.integers(0, n))
    b = draw.draw(st.integers(a, n))
    h = r.slices(np.array([a, a + n]), np.array([b, b + n]))
    assert h[0] == h[1]
    if b > a:
        k = b - a
        assert r.windows(k)[a] == h[0]


def test_flat_views_of_sliced_arrays():
    whole = pa.array(["ab", "", "é", "xyz"])
    for kind in (pa.string(), pa.large_string()):
        data, offs = shared.flat(whole.cast(kind).slice(1, 3))
        assert bytes(data) == "éxyz".encode() and offs.tolist() == [0, 0, 2, 5]
    data, offs = shared.flat(pa.array([], pa.string()))
    assert len(data) == 0 and offs.tolist() == [0]


def test_sieve_lets_every_wanted_row_through(spark, monkeypatch):
    monkeypatch.setattr(shared, "SIEVE_BITS", 1 << 14)
    docs = spark.range(6000).select(F.col("id").alias("_id"), F.xxhash64("id").alias("_th"))
    wanted = docs.where("_id % 40 = 0")
    sieve = shared.Sieve(wanted)
    rows = docs.select("_id", *(h.alias(n) for n, h in zip(("h1", "h2"), shared.Sieve.hashes(), strict=True))).toPandas()
    ok = sieve.passes(rows.h1.to_numpy(), rows.h2.to_numpy())
    assert ok[rows._id % 40 == 0].all() and ok.mean() < 0.1
    none = shared.Sieve(wanted.where("false"))
    assert not none.passes(rows.h1.to_numpy(), rows.h2.to_numpy()).any()


def test_shingles_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(3)
    texts = ["", "a", "  ", "A b\tc", "one two three four five six"] + [" ".join(rng.choice(["x", "Y", "zé"]) for _ in range(rng.randrange(40))) for _ in range(50)]
    whole = [s.tolist() for s in shingles.shingle_sets(pa.array(texts))]
    monkeypatch.setattr(shingles, "BLOCK", 17)
    assert [s.tolist() for s in shingles.shingle_sets(pa.array(texts))] == whole
    assert whole[0] == whole[2] == [] and len(whole[1]) == len(whole[3]) == 1 and len(whole[4]) == 2
    (lower,) = shingles.shingle_sets(pa.array(["a B C"]))
    assert lower.tolist() == whole[3]


def test_zip_round_trip():
    batch = pa.record_batch([pa.array([1, 2]), pa.array([3, 4]), pa.array(["", "text " * 1000])], names=["_id", "_th", "_text"])
    (out,) = shared.zipped(iter([batch]))
    assert [shared.unzip(z) for z in out.column("zipped").to_pylist()] == [b"", b"text " * 1000]


def test_identity_of_null_ids(spark):
    df = spark.createDataFrame([(None, None), (5, "a")], "doc_id long, text string")
    rows = shared.keyed(df).select(shared.public_id().alias("i"), "_text").collect()
    assert sorted(((r.i, r._text) for r in rows), key=str) == [(5, "a"), (None, "")]


def test_shared_folder_needs_a_setting_on_a_cluster():
    def session(master, **conf):
        context = SimpleNamespace(master=master, getConf=lambda: conf)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__))

    assert shared.shared_folder(session("yarn", **{"spark.checkpoint.dir": "hdfs:///c/"})) == "hdfs:///c"
    for master in ("yarn", "local-cluster[2,1,900]", "spark://h:7077"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.shared_folder(session(master))
    one = session("local[4]")
    assert shared.shared_folder(one).startswith("file:///") and shared.shared_folder(one) == shared.shared_folder(one)


def test_settings_of_the_session_stay(spark):
    before = dict(spark.conf.getAll)
    df = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    for made in (shared.keyed(df), shared.packed(df), lz_fingerprint.fingerprint(df), toxicity.score(df, None)):
        made.collect()
    assert {k: v for k, v in dict(spark.conf.getAll).items() if "millrace" not in k} == {k: v for k, v in before.items() if "millrace" not in k}
    assert [b.num_rows for b in shared.pieces(iter([pa.record_batch({"x": [1] * 25})]), 10)] == [10, 10, 5]
