"""Packed token-id matrices: best-fit-decreasing with a segment tree over free capacities.

Each task packs its own rows, ``run_tokens`` ids at a time, so nothing is shuffled and memory is bounded;
a lost task packs the same rows again. A document longer than a window is cut into full windows and a
rest, without loss. A segment tree over the capacities 0..window, whose leaves count the open rows with
that much room, gives the tightest row that still fits in logarithmic time.

A packed row holds ``ids`` (``window`` little-endian unsigned 16- or 32-bit ids, padded with ``pad_id``),
``cu_seqlens`` (cumulative segment lengths, starting with 0), ``position_resets`` (the places at which
positions start again from the piece's own start in its document) and doc_ids / starts of the pieces.

Cases: null and empty texts have their end id alone; repeated rows are packed each; a null id is
carried; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yieldloom.llm.common import slices, texts
from yieldloom.llm.tokens import tokenizer

WINDOW = 2048
END_ID = 1
RUN_TOKENS = 4 << 20


class Capacities:
    """A segment tree over capacities: how many open rows have each amount of room."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.tree = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        k = self.leaves + capacity
        while k:
            self.tree[k] += by
            k >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least ``need`` that some row has."""
        k = self.leaves + need
        if self.tree[k]:
            return need
        while k > 1:
            if not k & 1 and self.tree[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.tree[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return None


def best_fit(lengths: list[int], window: int) -> list[list[int]]:
    """Rows of indexes into ``lengths`` (each at most ``window``), longest first into the tightest row."""
    free, open_rows = Capacities(window), [[] for _ in range(window + 1)]
    rows: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = free.tightest(lengths[i])
        if room is None:
            rows.append([])
            row, room = len(rows) - 1, window
        else:
            row = open_rows[room].pop()
            free.add(room, -1)
        rows[row].append(i)
        open_rows[room - lengths[i]].append(row)
        free.add(room - lengths[i], 1)
    return rows


def _matrix(pieces: list[tuple[object, int, bytes]], window: int, pad_id: int, dtype: str, shard: int, first: int, schema: pa.Schema) -> pa.RecordBatch:
    rows = best_fit([len(p[2]) // 4 for p in pieces], window)
    cols: dict[str, list] = {name: [] for name in schema.names}
    for k, row in enumerate(rows):
        ids = np.frombuffer(b"".join(pieces[i][2] for i in row), dtype="<u4")
        line = np.full(window, pad_id, dtype=dtype)
        line[: len(ids)] = ids
        lengths = [len(pieces[i][2]) // 4 for i in row]
        cu = [0, *np.cumsum(lengths).tolist()]
        for name, value in (("shard", shard), ("row", first + k), ("ids", line.tobytes()), ("n_ids", len(ids)), ("cu_seqlens", cu), ("position_resets", cu[:-1]), ("doc_ids", [pieces[i][0] for i in row]), ("starts", [pieces[i][1] for i in row])):
            cols[name].append(value)
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)


def token_matrices(
    docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, pad_id: int = 0, run_tokens: int = RUN_TOKENS
) -> DataFrame:
    """One row for each packed matrix row: shard, row, ids, n_ids, cu_seqlens, position_resets, doc_ids,
    starts. (shard, row) is unique; a shard is the rows of one input partition."""
    end = end_id.to_bytes(4, "little")
    id_type = docs.schema["doc_id"].dataType
    ints, longs = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
    out = T.StructType().add("shard", T.LongType()).add("row", T.LongType()).add("ids", T.BinaryType()).add("n_ids", T.LongType()).add("cu_seqlens", ints).add("position_resets", ints).add("doc_ids", T.ArrayType(id_type)).add("starts", longs)

    def run(batches):
        words = tokenizer(vocabulary)
        dtype = "<u2" if words.whole.get_vocab_size() <= 1 << 16 else "<u4"
        shard = TaskContext.get().partitionId()
        id_arrow = None
        pieces: list[tuple[object, int, bytes]] = []
        held = first = 0
        schema = None
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                if schema is None:
                    id_arrow = batch.schema.field("doc_id").type
                    schema = pa.schema([("shard", pa.int64()), ("row", pa.int64()), ("ids", pa.binary()), ("n_ids", pa.int64()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(id_arrow)), ("starts", pa.list_(pa.int64()))])
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True):
                    ids = words.pack(text) + end
                    for at in range(0, len(ids), 4 * window):
                        pieces.append((doc_id, at // 4, ids[at : at + 4 * window]))
                    held += len(ids) // 4
                    if held >= run_tokens:
                        made = _matrix(pieces, window, pad_id, dtype, shard, first, schema)
                        yield made
                        first, held, pieces = first + made.num_rows, 0, []
        if pieces:
            yield _matrix(pieces, window, pad_id, dtype, shard, first, schema)

    return docs.select("doc_id", F.col("text")).mapInArrow(run, out)


def write_matrices(matrices: DataFrame, path: str) -> None:
    """Parquet under ``path``, one file for each task."""
    matrices.write.parquet(path)


def read_pieces(matrices: DataFrame) -> DataFrame:
    """One row for each piece of packed rows: doc_id, start, length, begin (its place in the row), ids (the row's)."""
    piece = F.posexplode(F.arrays_zip("doc_ids", "starts", F.col("position_resets").alias("begin"))).alias("k", "piece")
    return matrices.select("ids", "cu_seqlens", piece).select(
        F.col("piece.doc_ids").alias("doc_id"),
        F.col("piece.starts").alias("start"),
        (F.element_at("cu_seqlens", F.col("k") + 2) - F.col("piece.begin")).alias("length"),
        F.col("piece.begin").alias("begin"),
        "ids",
    )
