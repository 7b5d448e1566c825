"""Helpers shared by the training-data operators: tables, scratch storage, word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the substring, quality and near-duplicate operators are runs of other bytes than these.
WORD_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stage_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def with_maybe(df: DataFrame, id_col: str, ids: DataFrame, flag: str, bits: int = 25) -> DataFrame:
    """``df`` with a flag that is true for every row whose id is in ``ids``, and for few others.

    The ids set bits of a bitmap by their hash; it is broadcast as at most 2^(bits - 6) words of 64 bits, however many ids there are.
    So only rows that may match go through a shuffle. When the bitmap fills up more rows are flagged, and results stay the same.
    """
    at, bit_, word, bits_ = (f"maybe_{k}_" + "_" * sum(map(len, df.columns)) for k in ("at", "bit", "word", "bits")) if any(c.startswith("maybe_") for c in df.columns) else ("maybe_at", "maybe_bit", "maybe_word", "maybe_bits")
    slot = f"pmod(xxhash64(`{id_col}`, 77), {1 << bits}L)"
    bit = f"shiftleft(1L, cast({slot} & 63 as int))"
    words = ids.select(F.expr(f"shiftright({slot}, 6)").alias(at), F.expr(bit).alias(bit_)).groupBy(at).agg(F.bit_or(bit_).alias(bits_))
    out = df.withColumn(word, F.expr(f"shiftright({slot}, 6)")).join(F.broadcast(words), F.col(word) == F.col(at), "left")
    return out.withColumn(flag, F.coalesce(F.expr(f"({bits_} & {bit}) <> 0"), F.lit(False))).select(*df.columns, flag)


def crc_mod(key: str, n: int):
    """crc32 of the id as text, modulo n: the fixed folds."""
    return F.crc32(F.col(key).cast("string")) % n


def sampled(key: str, share):
    """True for about this share of the rows, by a hash of the key alone, so alike on every run."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(41)), F.lit(1 << 30)) < share * float(1 << 30)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, most: dict[int, int], id_col: str, text_col: str) -> tuple[DataFrame, dict[int, int], dict[int, float]]:
    """Whole texts with their 0/1 label, about ``most[label]`` of each: (id, text, label), labels' counts, and shares taken.

    The sample is drawn from the label table by a hash of the id; what meets the texts is bounded by ``most``, so it is
    broadcast. Other labels, null texts and ids are left out; an id with several labels has the greatest.
    """
    labels = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")).where(F.col(id_col).isNotNull() & F.col("label").isin(0, 1))
    labels = labels.groupBy(id_col).agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    shares = {k: min(1.0, most[k] / max(1, sizes.get(k, 0))) for k in (0, 1)}
    drawn = labels.where(sampled(id_col, F.when(F.col("label") == 1, F.lit(shares[1])).otherwise(F.lit(shares[0]))))
    texts = docs.select(F.col(id_col), F.col(text_col).alias("text")).where("text IS NOT NULL")
    return texts.join(F.broadcast(drawn), id_col), sizes, shares


class WordHashes(dict):
    """Word (bytes) to 64-bit hash; forgets everything when it has grown to ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, grown by doubling."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(12, int(n).bit_length())
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            tables.append(np.cumprod(factors, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0], _powers[1]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of each window of ``size`` word hashes, by prefix sums modulo 2^64."""
    n = len(hashes)
    if n < size:
        return np.empty(0, np.uint64)
    power, inverse = _power_tables(n + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[:n], dtype=np.uint64)])
        return mix((total[size:] - total[: n - size + 1]) * inverse[: n - size + 1])


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]
