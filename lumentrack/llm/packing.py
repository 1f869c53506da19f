"""Best-fit-decreasing packing of token ids into rows of one length.

Segments go, longest first, into the fullest row that still has room; a segment tree over the rooms finds it. Packing
is done in windows of a bounded number of tokens, read in turn by each task, so nothing is shuffled or gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentrack.llm.bpe import runs, vocabulary

ROW_TOKENS = 2048
#: A window closes once it has so many tokens, which bounds a task's memory but for one document.
WINDOW_TOKENS = 1 << 21


class Rooms:
    """Open rows by the room that they have left, in a segment tree whose nodes count the rows below them."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def _add(self, room: int, n: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += n
            node >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of ``need`` or more, and that room; it is no longer open."""
        count, node = self.count, self.leaves + need
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # up, until there are rows to the right
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of indices into ``lengths`` (none above ``capacity``). Of equal lengths the first index goes first."""
    rooms, rows = Rooms(capacity), []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        found = rooms.take(lengths[i])
        if found is None:
            found = len(rows), capacity
            rows.append([])
        row, room = found
        rows[row].append(i)
        rooms.put(room - lengths[i], row)
    return rows


def packed(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text: str = "text", row_tokens: int = ROW_TOKENS, window_tokens: int = WINDOW_TOKENS, end_id: int = 50256) -> DataFrame:
    """A row per packed row of ids: pack_id, n_tokens, ids, positions, cu_seqlens, doc_ids, parts, starts.

    Every document's ids end with ``end_id``. Documents beyond ``row_tokens`` are split without loss: segment k of
    a row is part parts[k] of document doc_ids[k], whose ids from starts[k] on it holds. ``ids`` (unsigned 32-bit)
    and ``positions`` (signed 32-bit, from 0 again in each segment) are little-endian and ``row_tokens`` long;
    what lies beyond n_tokens is padding by ``end_id`` at position 0. ``cu_seqlens`` are the cumulative segment lengths from 0.
    Null and empty texts are the lone ``end_id``; repeated rows are packed each; null ids stay null. pack_id is the
    task's number and a count, so it is the same again where the input is a scan of the same files.
    """

    ramp = np.arange(row_tokens, dtype="<i4")

    def rows_of(segments: list[tuple[object, int, int, np.ndarray]]) -> Iterator[tuple]:
        for row in best_fit_decreasing([len(s[3]) for s in segments], row_tokens):
            ids, positions = np.full(row_tokens, end_id, "<u4"), np.zeros(row_tokens, "<i4")
            cuts = [0]
            for i in row:
                part = segments[i][3]
                ids[cuts[-1] : cuts[-1] + len(part)] = part
                positions[cuts[-1] : cuts[-1] + len(part)] = ramp[: len(part)]
                cuts.append(cuts[-1] + len(part))
            yield cuts[-1], ids.tobytes(), positions.tobytes(), cuts, *([segments[i][k] for i in row] for k in range(3))

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, task, made = vocabulary(path, pattern), TaskContext.get().partitionId(), 0
        segments, held, id_type, end_bytes = [], 0, pa.int64(), np.uint32(end_id).tobytes()

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal made
            rows = list(rows_of(segments))
            for i in range(0, len(rows), 256):
                n, ids, positions, cuts, doc_ids, parts, starts = zip(*rows[i : i + 256], strict=True)
                pack = [(task << 33) + made + k for k in range(len(n))]
                made += len(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pack, pa.int64()), pa.array(n, pa.int32()), pa.array(ids, pa.binary()), pa.array(positions, pa.binary()), pa.array(cuts, pa.list_(pa.int32())), pa.array(doc_ids, pa.list_(id_type)), pa.array(parts, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int64()))],
                    names=["pack_id", "n_tokens", "ids", "positions", "cu_seqlens", "doc_ids", "parts", "starts"],
                )

        for whole in batches:
            id_type = whole.column(0).type
            for batch in runs(whole):
                for doc, packed_ids in zip(batch.column(0).to_pylist(), v.encode_all([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                    ids = np.frombuffer(packed_ids + end_bytes, "<u4")
                    segments += [(doc, k, at, ids[at : at + row_tokens]) for k, at in enumerate(range(0, len(ids), row_tokens))]
                    held += len(ids)
                    if held >= window_tokens:
                        yield from close()
                        segments, held = [], 0
        yield from close()

    return source.mapInArrow(run, f"pack_id long, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<{kind}>, parts array<int>, starts array<long>")


def write_packed(rows: DataFrame, path: str) -> None:
    """The packed rows as Parquet: ``ids`` and ``positions`` are matrices with a row for each record."""
    rows.write.option("parquet.enable.dictionary", "false").parquet(path)


def packing_digests(rows: DataFrame) -> DataFrame:
    """Packed rows with digests in place of the ids and positions."""
    return rows.select("pack_id", "n_tokens", "cu_seqlens", "doc_ids", "parts", "starts", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"))
