"""Product codes of vectors: integer k-means of each part by RDD treeAggregate over columnar NumPy blocks.

Each component x becomes the integer floor(SCALE * x); a vector is cut into equal consecutive parts, and each part
position has a codebook of its own. A codebook starts as that part of the vectors with the smallest ids. In each round
every part goes to the nearest entry (squared Euclidean distance, ties to the lower index) and each entry becomes the
componentwise floor(sum / count) of its parts; entries without parts stay. All arithmetic is in whole numbers, so the
result doesn't depend on how rows are dealt to tasks, and runs agree.

The vectors are written once as blocks, each one column of integers for every dimension, and a round is one
treeAggregate over an RDD of these blocks: a task adds up distances dimension by dimension for a block, adds the block to
int64 tensors of sums and counts with np.add.at, and the tensors (parts x entries x components, the same size for any
table) merge through a tree of reducers. The driver holds the codebooks and one such tensor. Lost executors' blocks are
read again from the shared folder.

Null vectors, vectors with null or non-finite components and empty vectors are dropped, and so are vectors of another
length than that of the vector with the smallest id, or all if that length can't be cut into the parts. Components beyond
+-LIMIT/SCALE count as that bound, so that sums of squares fit 64 bits. Null ids: such rows are coded, but don't begin a
codebook. Rows that repeat an id: each is coded; the smallest of their vectors begins a codebook. Fewer ids than entries:
as many entries. Null labels are one label. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, settle, task_batches

SCALE, LIMIT = 4096, 1 << 27
#: Vectors of a block.
BLOCK = 4096


def whole_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector has only finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False)))


def whole_numbers(vector: Column) -> Column:
    """The components as integers."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(F.lit(float(SCALE)) * x.cast("double")))).cast("int"))


def matrix(column, size: int) -> np.ndarray:
    """Rows of an Arrow list column whose lists are all of one size."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def blocks(numbers: DataFrame, size: int) -> DataFrame:
    """A row for each block: its count, and its integers column after column."""

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, n = [], 0

        def out() -> pa.RecordBatch:
            block = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array([len(block)]), pa.array([np.ascontiguousarray(block.T, "<i4").tobytes()], pa.binary())], names=["n", "columns"])

        for batch in task_batches(batches, "vectors"):
            held.append(matrix(batch.column(0), size))
            n += batch.num_rows
            if n >= BLOCK:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return numbers.transform(map_arrow, pack, "n long, columns binary")


def nearest(columns: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part and vector the nearest entry and the squared distance; columns: dimensions x vectors."""
    parts, entries, width = codebooks.shape
    codes = np.empty((parts, columns.shape[1]), np.int64)
    apart = np.empty((parts, columns.shape[1]), np.int64)
    for p in range(parts):
        far = np.zeros((entries, columns.shape[1]), np.int64)
        for j in range(width):
            step = columns[p * width + j][None, :] - codebooks[p, :, j][:, None]
            far += step * step
        codes[p] = far.argmin(axis=0)
        apart[p] = np.take_along_axis(far, codes[p][None, :], axis=0)[0]
    return codes, apart


def added(total: tuple[np.ndarray, np.ndarray], columns: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums (parts x entries x components) and counts (parts x entries) with a block's parts put to their entries."""
    sums, counts = total
    codes, _ = nearest(columns, codebooks)
    parts, _, width = codebooks.shape
    for p in range(parts):
        np.add.at(sums[p], codes[p], columns[p * width : (p + 1) * width].T)
        np.add.at(counts[p], codes[p], 1)
    return sums, counts


def moved(codebooks: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], codebooks)


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The parts of the vectors with the smallest ids, at most `entries` of them; none if there is no fit vector."""
    ids = [r["vec_id"] for r in rows.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    first = rows.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("numbers").alias("numbers")).orderBy("vec_id").collect()
    size = len(first[0]["numbers"]) if first else 0
    if not size or size % parts:
        return None
    start = np.array([r["numbers"] for r in first if len(r["numbers"]) == size], np.int64)
    return np.ascontiguousarray(start.reshape(len(start), parts, size // parts).transpose(1, 0, 2))


def fit_codebooks(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> np.ndarray | None:
    """parts x entries x components, from rows of vec_id and numbers (all of them)."""
    codebooks = first_codebooks(rows, parts, entries)
    if codebooks is None:
        return None
    size = codebooks.shape[0] * codebooks.shape[2]
    kept = settle(blocks(rows.where(F.size("numbers") == size).select("numbers"), size))
    held = kept.rdd.map(lambda r: np.frombuffer(bytes(r["columns"]), "<i4").reshape(size, r["n"]).astype(np.int64))
    sc = rows.sparkSession.sparkContext
    for _ in range(rounds):
        shared = sc.broadcast(codebooks)  # as large for any table
        none = (np.zeros(codebooks.shape, np.int64), np.zeros(codebooks.shape[:2], np.int64))
        sums, counts = held.treeAggregate(none, lambda total, block: added(total, block, shared.value), lambda x, y: (x[0] + y[0], x[1] + y[1]), depth=3)
        codebooks = moved(codebooks, sums, counts)
        shared.destroy()
    return codebooks


def codebook_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def with_codes(rows: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits a part) and error of every vector."""
    size = codebooks.shape[0] * codebooks.shape[2]

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in task_batches(batches, "vectors", BLOCK):
            codes, apart = nearest(matrix(batch.column("numbers"), size).astype(np.int64).T, codebooks)
            text = [bytes(c).hex() for c in codes.T.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(apart.sum(axis=0))], names=["vec_id", "label", "code", "error"])

    fit = rows.where(F.size("numbers") == size).select("vec_id", "label", "numbers")
    label = fit.schema["label"].dataType.simpleString()
    return map_arrow(fit, encode, f"vec_id long, label {label}, code string, error long")


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """vec_id, code, error, label_error (errors summed over the rows of a label) and the digest of the codebooks.

    vectors: vec_id, embedding, label. Labels are summed before they are shuffled; the sums, a row for each label, are
    broadcast only where Spark finds them small, and else joined by a shuffle that splits a hot label.
    """
    rows = whole_vectors(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label"), "embedding").select("vec_id", "label", whole_numbers(F.col("embedding")).alias("numbers"))
    codebooks = fit_codebooks(rows, parts, entries, rounds)
    if codebooks is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = settle(with_codes(rows, codebooks))
    totals = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(totals, coded["label"].eqNullSafe(totals["_label"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(codebooks)).alias("codebooks_sha256"))
