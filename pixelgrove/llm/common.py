"""What the document operators share: column selection, hashing, cutting lineage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that other columns can have any name."""
    return docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder that the cluster shares, and go on from there.

    The session's own folder holds; in local mode, as in tests, one is made where none is set.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


#: Ids are broadcast up to this number (8 MB), and joined beyond it.
MOST_SENT = 1_000_000


def small(ids: DataFrame) -> DataFrame:
    """ids (one long column, distinct), marked for broadcast if they are counted to be few."""
    return F.broadcast(ids) if ids.limit(MOST_SENT + 1).count() <= MOST_SENT else ids


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """rows with ``place``, from 0 in the order of ``by`` (distinct), without one task for all of them."""
    rows = cut(rows.orderBy(by).withColumn("part", F.spark_partition_id()))
    begin, starts = 0, []
    for r in sorted(rows.groupBy("part").count().collect()):  # a row for each partition
        starts.append((r["part"], begin))
        begin += r["count"]
    starts = rows.sparkSession.createDataFrame(starts, "part int, begin long")
    within = F.row_number().over(Window.partitionBy("part").orderBy(by)) - 1
    return rows.join(F.broadcast(starts), "part").select(*[c for c in rows.columns if c != "part"], (within + F.col("begin")).alias("place"))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows and about so many bytes at most, so that few texts are held at a time.

    A part larger than that is one row.
    """
    for b in batches:
        for at in range(0, b.num_rows, rows):
            parts = [b.slice(at, rows)]
            while parts:
                part = parts.pop()
                if part.num_rows > 1 and part.nbytes > size:
                    half = part.num_rows // 2
                    parts += [part.slice(half), part.slice(0, half)]
                else:
                    yield part


def filter_texts(docs: DataFrame, text_col: str, make: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """The rows of docs whose text passes what make() returns (called once a task); all columns stay, without a shuffle."""
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches):
        passes = make()
        for b in sliced(batches):
            kept = b.filter(pa.array([passes(t) for t in b.column(at).to_pylist()], pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (the splitmix64 one)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_WRAP = (1 << 64) - 1


def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(_BLOCK, base, np.uint64)]))


_POWERS, _INVERSES = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins (and the last ends); null as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None and len(ends) else np.zeros(0, np.uint8)
    return data, ends - ends[0] if len(ends) else np.zeros(1, np.int64)


def word_bounds(data: np.ndarray, ends: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word in the bytes, and how many words each text has.

    Words are runs of bytes other than ``gaps``, \\x20 and \\x09 to \\x0D by default; none reaches over a text's edge.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends) - 1, np.int64)
    solid = ~gaps[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[ends] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.diff(np.searchsorted(starts, ends))


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lowered: polynomials by prefix sums, in blocks, so that memory stays bounded."""
    low, high, inverse = (np.empty(len(starts), dtype=np.uint64) for _ in range(3))
    carry, scale, back = 0, 1, 1
    step, unstep = pow(_BASE, _BLOCK, 1 << 64), pow(_BASE, -_BLOCK, 1 << 64)
    a = b = 0
    for at in range(0, len(data), _BLOCK):
        part = LOWER[data[at : at + _BLOCK]]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(part)], out=sums[1:])
        # A word's start lies before its first byte, its end after its last one.
        c, d = np.searchsorted(starts, at + len(part)), np.searchsorted(stops, at + len(part), "right")
        low[a:c] = np.uint64(carry) + np.uint64(scale) * sums[starts[a:c] - at]
        inverse[a:c] = _INVERSES[starts[a:c] - at] * np.uint64(back)
        high[b:d] = np.uint64(carry) + np.uint64(scale) * sums[stops[b:d] - at]
        a, b = c, d
        carry = (carry + scale * int(sums[-1])) & _WRAP
        scale, back = scale * step & _WRAP, back * unstep & _WRAP
    return mix((high - low) * inverse)


class Memo(dict):
    """A bounded cache: make(key) fills it, and it starts anew when it is full."""

    def __init__(self, make, limit: int = 300_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value
