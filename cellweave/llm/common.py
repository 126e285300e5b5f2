"""Small helpers that the operators share: input columns, Arrow text as bytes, staged tables."""

from __future__ import annotations

import contextlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellweave.session import scratch_path

#: White space of all operators, as a Java, Python and RE2 character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: While a caller keeps account (``accounted``), the paths that ``staged`` has written for it.
_ACCOUNT: list[str] | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def id_text(df: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and the named columns; whatever else there is stays out of the scan."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *more)


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """Write to the shared folder, with the writer's options, and read back: work done once, kept when executors are lost."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    if _ACCOUNT is not None:
        _ACCOUNT.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def accounted() -> Iterator[list[str]]:
    """The paths staged inside, for ``delete`` once nothing reads them any more."""
    global _ACCOUNT
    before, _ACCOUNT = _ACCOUNT, []
    try:
        yield _ACCOUNT
    finally:
        _ACCOUNT = before


def delete(spark: SparkSession, paths: list[str]) -> None:
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a text column; nulls are empty. Offset 0 is the first text's start."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offs - offs[0] if len(offs) else np.zeros(1, np.int64), raw[offs[0] : offs[-1]] if len(offs) else raw


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that a piece has about ``limit`` bytes of text; a longer text is alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offs, _ = utf8(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offs, offs[start] + limit, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words (multiply, shift, xor)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], size: str, n_rows: int) -> DataFrame:
    """Inner join of rows with one fact row per key, where a key may have a large part of all rows.

    ``size`` is a column of the facts: the key's rows. Keys with a thousandth of all rows are a thousand
    at most and are broadcast; each other key is too small to make a task of the join uneven.
    """
    least = max(1000, n_rows // 1000)
    more = [c for c in facts.columns if c not in keys]
    hot = facts.where(F.col(size) >= least)
    flagged = rows.join(F.broadcast(hot.select(*keys, F.lit(True).alias("_hot"))), keys, "left")
    many = flagged.where("_hot").drop("_hot").join(F.broadcast(hot), keys)
    rest = flagged.where("_hot IS NULL").drop("_hot").join(facts.where(F.col(size) < least), keys)
    order = [*rows.columns, *more]
    return rest.select(*order).unionByName(many.select(*order))


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete groups, about ``rows`` rows each, with the groups' bounds.

    The batches come sorted by the keys, which are integers without nulls.
    """
    held: list[pa.RecordBatch] = []
    count = 0

    def bounds(t: pa.Table) -> np.ndarray:
        change = np.zeros(max(t.num_rows - 1, 0), bool)
        for k in keys:
            v = t.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1, [t.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            at = bounds(t)
            if len(at) > 2:
                yield t.slice(0, int(at[-2])), at[:-1]
            held = t.slice(int(at[-2])).to_batches()
            count = sum(b.num_rows for b in held)
            rows = max(rows, 2 * count)  # a long group is gathered without looking again at each batch
    if count:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, bounds(t)
