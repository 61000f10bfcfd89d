"""Helpers shared by the corpus operators.

Texts travel to Python as UTF-8 bytes: ``bytes.translate`` and
``bytes.split`` work at memory speed and never build per-character objects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Word rule of the text operators: lower-case A-Z, then words are runs of
# 0-9, a-z and everything above ASCII.
_KEPT = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20) for b in range(256))
# Lower-cases A-Z alone.
LOWER = bytes((b + 32 if 0x41 <= b <= 0x5A else b) for b in range(256))
CONTINUATION = bytes(range(0x80, 0xC0))     # UTF-8 bytes that do not start a code point


BATCH_ROWS = 512
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def bounded_batches(spark: SparkSession) -> None:
    """Rows that hold whole texts go to Python ``BATCH_ROWS`` at a time: Spark's default of 10,000 long
    texts would fill a worker's memory.  A session that has set the size itself keeps it."""
    if spark.conf.get(_BATCH, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` has it (whatever its case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def code_points(b: bytes) -> int:
    return len(b.translate(None, CONTINUATION))


def fold_words(b: bytes) -> list[bytes]:
    return b.translate(FOLD).split()


def append_columns(df: DataFrame, text_col: str, fields: list[tuple[str, T.DataType]],
                   make: Callable[[], Callable[..., list]], keep_text: bool = True,
                   consume: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with columns computed from each row's whole text.

    ``make()`` runs once per task and returns a function from a list of texts
    (bytes or None), and a list for each ``consume`` column, to one value list
    per field.  Every other column passes through unchanged, so no join is
    needed to put a decision beside its row; ``consume`` columns, and with
    ``keep_text=False`` the text, are left behind in the worker.
    """
    [text] = fresh(df, "text_utf8_")
    given = [c for c in df.columns if c not in consume and (keep_text or c.lower() != text_col.lower())]
    names = given + [n for n, _ in fields]
    kept = df.select(*[F.col(f"`{c}`") for c in given])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in kept.schema.fields]
                          + [T.StructField(n, t, True) for n, t in fields])
    arrow_types = [arrow_type(t) for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = make()
        for batch in batches:
            passed, read = batch.columns[:len(given)], batch.columns[len(given):]
            made = values(*[c.to_pylist() for c in read])
            yield pa.RecordBatch.from_arrays(
                passed + [pa.array(v, type=t) for v, t in zip(made, arrow_types)], names=names)

    sent = df.select(*[F.col(f"`{c}`") for c in given],
                     F.col(f"`{text_col}`").cast("string").cast("binary").alias(text),
                     *[F.col(f"`{c}`") for c in consume])
    return sent.mapInArrow(run, schema)


def arrow_type(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(arrow_type(t.elementType))
    if isinstance(t, T.StructType):
        return pa.struct([pa.field(f.name, arrow_type(f.dataType)) for f in t.fields])
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
            "boolean": pa.bool_(), "binary": pa.binary()}[t.simpleString()]


FILTER_BITS = 1 << 23


class HashFilter:
    """A one-hash Bloom filter of fixed size (1 MB unless ``bits`` says otherwise): says which rows of a second pass
    are worth their work.  It may let others through (an exact join follows), and never loses one; with more
    keys it only becomes less selective, so what is collected and broadcast does not grow."""

    def __init__(self, keys: DataFrame, col: str, bits: int = FILTER_BITS):
        self.bits = bits
        bit = F.col(col).bitwiseAND(F.lit(bits - 1))
        found = keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(
            F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
        words = np.zeros(bits // 64, np.int64)
        words[found.column(0).to_numpy()] = found.column(1).to_numpy()
        self.shared = keys.sparkSession.sparkContext.broadcast(words.tobytes())

    def test(self) -> Callable[[int], int]:
        """In a task: whether a key (a signed 64-bit hash) may be among the keys."""
        words, last = np.frombuffer(self.shared.value, np.uint64).tolist(), self.bits - 1
        return lambda key: words[(key & last) >> 6] >> (key & 63) & 1

    def mask(self) -> Callable[[np.ndarray], np.ndarray]:
        """The same for an array of keys."""
        words = np.frombuffer(self.shared.value, np.uint64)

        def test(keys: np.ndarray) -> np.ndarray:
            bit = keys.view(np.uint64) & np.uint64(self.bits - 1)
            return (words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
        return test


BROADCAST_CELLS = 1_000_000


def small_side(written: DataFrame, cells: Column | None = None, most: int = BROADCAST_CELLS) -> DataFrame:
    """A written table, marked for broadcast if it has at most ``most`` values of fixed size (``cells`` to a
    row, by default its columns), so that the whole documents on the other side stay where they are; a
    larger one is joined as Spark decides."""
    cells = F.lit(len(written.columns)) if cells is None else cells
    return F.broadcast(written) if (written.agg(F.sum(cells)).first()[0] or 0) <= most else written
