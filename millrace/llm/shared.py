"""What the operators of this subpackage share: row identity, written tables, flat byte views and rolling hashes.

Row identity. Tables are keyed by an id column, but the operators accept null and repeated ids.
``keyed`` gives each row the internal pair (``_id``, ``_th``): the id, null counting as the smallest long,
and the 64-bit hash of the text, null counting as empty. Rows alike in both are the same text under the same
id, so they get the same answer, and a join back on the pair returns every input row exactly once.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = -(2**63)
BATCH_ROWS = 1000
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one, if all run on this machine (tests)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.millrace.shared.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master}): each machine would keep its part of a table to itself")
        folder = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.millrace.shared.dir", folder)
    return folder.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it Spark sends Python workers at most BATCH_ROWS rows at once; the caller's setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(min(BATCH_ROWS, int(was)) if int(was) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage, and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(remove_written)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def remove_written() -> None:
    """Delete every table that ``written`` made in this application; call it once results have been stored."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has already ended
            return


def pieces(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Each batch in slices of at most ``rows`` rows, without a copy: whole texts can be long, and a worker holds what it works on several times over."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id long, _th long, _text string): identity and whole text of every row, and nothing else."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(row_id(id_col).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))


def row_id(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))


def public_id(id_col: str = "_id") -> Column:
    """The id as it was read: null where ``row_id`` put the smallest long."""
    return F.nullif(F.col(id_col), F.lit(NULL_ID))


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_row, _id, _th): every row as one struct, so that no column of the caller's clashes with an operator's own."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), row_id(id_col).alias("_id"), F.xxhash64(text).alias("_th"))


def unpacked(df: DataFrame, *new: str) -> DataFrame:
    """The columns of _row and the columns ``new``, which replace input columns of the same name."""
    names = df.schema["_row"].dataType.names
    return df.select(*(F.col(f"_row.`{c}`").alias(c) for c in names if c not in new), *new)


SIEVE_BITS = 1 << 26


class Sieve:
    """A Bloom filter over (_id, _th) pairs of at most ``SIEVE_BITS`` bits (8 MB): keeps rows that can't match out of a shuffle.

    It lets every wanted pair through, and others at a rate that rises as the wanted ones outgrow it; a join follows it.
    own: two hashes of a row of ``wanted``, where it has other columns than the pair."""

    def __init__(self, wanted: DataFrame, own: tuple[Column, Column] | None = None) -> None:
        n = wanted.count()
        self.bits = min(SIEVE_BITS, 1 << max(12, (16 * n).bit_length()))
        h1, h2 = own or self.hashes()
        at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.pmod(h1.bitwiseAND(F.lit(2**40 - 1)) + k * h2.bitwiseAND(F.lit(2**40 - 1)), F.lit(self.bits))))
        words = wanted.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set")).toArrow()
        self.words = np.zeros(self.bits >> 6, np.int64)
        self.words[words.column("word").to_numpy()] = words.column("set").to_numpy()

    @staticmethod
    def hashes() -> tuple[Column, Column]:
        """Two hashes of a row; ``passes`` takes their values."""
        return F.xxhash64("_id", "_th"), F.xxhash64(F.lit(7), "_th", "_id")

    def passes(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h1), bool)
        for k in range(4):
            at = ((h1 & (2**40 - 1)) + k * (h2 & (2**40 - 1))) % self.bits
            ok &= (self.words[at >> 6] >> (at & 63)) & 1 == 1
        return ok


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array without nulls, end to end, and the n + 1 offsets; no copy."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, xor-shift): every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, _th, zipped) of (_id, _th, _text) batches: each text compressed on its own, for the shuffle."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        data, offs = flat(batch.column("_text"))
        view = memoryview(np.ascontiguousarray(data))
        packed_texts = [pack(view[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        yield pa.record_batch([batch.column("_id"), batch.column("_th"), pa.array(packed_texts, pa.binary())], names=["_id", "_th", "zipped"])


def passing(own: DataFrame, sieve: Sieve, wanted: bool, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``run`` makes of the ``keyed`` rows (_id, _th, _text) that pass the sieve, or with ``wanted`` false of those that don't."""
    shared = own.sparkSession.sparkContext.broadcast(sieve)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = shared.value.passes(batch.column("h1").to_numpy(), batch.column("h2").to_numpy()) == wanted
            if ok.any():
                yield batch.filter(pa.array(ok)).select(["_id", "_th", "_text"])

    h1, h2 = Sieve.hashes()
    return own.select("_id", "_th", h1.alias("h1"), h2.alias("h2"), "_text").mapInArrow(lambda batches: run(some(batches)), schema)


def sieved(own: DataFrame, sieve: Sieve) -> DataFrame:
    """(_id, _th, zipped) of the ``keyed`` rows that pass the sieve."""
    return passing(own, sieve, True, zipped, "_id long, _th long, zipped binary")


def unzip(zipped: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(zipped) if zipped else b""


class Rolling:
    """Polynomial hashes modulo 2**64 of any slices of one flat array of symbols.

    The base is odd, so it has an inverse, and a slice's hash is (prefix[end] - prefix[start]) * inverse**start.
    Each symbol is mixed to 64 bits first. Powers are kept and grown as longer arrays come.
    """

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 2**64)
    _pow = np.ones(1, np.uint64)
    _inv = np.ones(1, np.uint64)

    @classmethod
    def powers(cls, n: int) -> None:
        have = len(cls._pow)
        if n >= have:
            size = max(1 << 16, 1 << int(n).bit_length())
            for name, base in (("_pow", cls.BASE), ("_inv", cls.INVERSE)):
                out = np.empty(size + 1, np.uint64)
                out[0] = 1
                k = 1
                while k <= size:
                    m = min(k, size + 1 - k)
                    out[k : k + m] = out[:m] * np.uint64(pow(base, k, 2**64))
                    k += m
                setattr(cls, name, out)

    def __init__(self, symbols: np.ndarray, table: np.ndarray | None = None) -> None:
        n = len(symbols)
        self.powers(n)
        codes = table[symbols] if table is not None else mix(symbols.astype(np.uint64) + np.uint64(1))
        self.prefix = np.empty(n + 1, np.uint64)
        self.prefix[0] = 0
        np.cumsum(codes * self._pow[:n], out=self.prefix[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self._inv[start]

    def windows(self, k: int) -> np.ndarray:
        """Hashes of every slice of k symbols."""
        n = len(self.prefix) - k
        return (self.prefix[k:] - self.prefix[:n]) * self._inv[:n] if n > 0 else np.empty(0, np.uint64)


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
