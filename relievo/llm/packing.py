"""Packing documents into sequences by minimum bin slack.

Every task packs what it reads, a window of about ``window`` ids at a time, so nothing is
shuffled and no more than a window and one document are held.  Whole stretches of
``length`` ids of a document are sequences of their own.  What remains of the documents has
lengths below that; the multiset of these lengths fills one sequence after the other: the
largest goes in first, then a subset-sum over bitsets (an int whose bit s says that s can be
reached, each length added with its count in powers of two) picks the lengths that come
closest to what is left, with the counts found by going back through the bitsets.  Slack that
no choice fills is filled by cutting the largest remaining piece.  What is left of a task's
last window, less than one sequence, is cut into powers of two.

Defined cases: null and empty text are one end id; repeated rows are packed each; null
doc_id is kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relievo.llm.common import text_of
from relievo.llm.encoding import encoder

Piece = tuple[int, int, int]  # document, start, length


def closest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take for the largest sum that is no more than ``room``."""
    reach, within, steps = 1, (1 << (room + 1)) - 1, []
    for size in sorted((s for s in counts if s <= room), reverse=True):
        left, many = min(counts[size], room // size), 1
        while left:
            many = min(many, left)
            steps.append((size, many, reach))
            reach |= (reach << size * many) & within
            left, many = left - many, many * 2
        if reach >> room & 1:
            break
    best, taken = reach.bit_length() - 1, {}
    for size, many, before in reversed(steps):
        if not before >> best & 1:
            taken[size] = taken.get(size, 0) + many
            best -= size * many
    return taken


class Packer:
    """Fills sequences; ``done`` has lists of pieces."""

    def __init__(self, length: int):
        self.length, self.open, self.total, self.done = length, {}, 0, []

    def add(self, doc: int, n: int) -> None:
        whole = n // self.length * self.length
        self.done += [[(doc, start, self.length)] for start in range(0, whole, self.length)]
        if n > whole:
            self._put((doc, whole, n - whole))

    def _put(self, piece: Piece) -> None:
        self.open.setdefault(piece[2], []).append(piece)
        self.total += piece[2]

    def _take(self, size: int) -> Piece:
        pieces = self.open[size]
        piece = pieces.pop()
        if not pieces:
            del self.open[size]
        self.total -= size
        return piece

    def _cut(self, room: int) -> Piece:
        """``room`` ids of the largest piece, which has at least as many."""
        doc, start, size = self._take(max(self.open))
        if size > room:
            self._put((doc, start + room, size - room))
        return doc, start, room

    def fill(self) -> None:
        """Sequences without slack, as long as there are ids for one."""
        while self.total >= self.length:
            sequence = [self._take(max(self.open))]
            room = self.length - sequence[0][2]
            for size, many in closest({s: len(p) for s, p in self.open.items()}, room).items():
                sequence += [self._take(size) for _ in range(many)]
                room -= size * many
            while room:
                piece = self._cut(min(room, max(self.open)))
                sequence.append(piece)
                room -= piece[2]
            self.done.append(sequence)

    def rest(self) -> None:
        """What is left, in sequences of a power of two."""
        while self.total:
            room, sequence = 1 << (self.total.bit_length() - 1), []
            while room:
                piece = self._cut(min(room, max(self.open)))
                sequence.append(piece)
                room -= piece[2]
            self.done.append(sequence)


def _packing(tokenizer: str, ranks: str | None, end_id: int, length: int, window: int):
    end = end_id.to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer, sequence_id = encoder(tokenizer, ranks), Packer(length), TaskContext.get().partitionId() << 33
        docs: list[tuple[object, bytes] | None] = []
        id_type = None

        def flush() -> pa.RecordBatch:
            nonlocal sequence_id
            rows = []
            for sequence in packer.done:
                offset = 0
                for doc, start, size in sequence:
                    doc_id, ids = docs[doc]
                    rows.append((doc_id, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), len(ids) // 4, sequence_id, offset))
                    offset += size
                sequence_id += 1
            packer.done = []
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, id_type if k == 0 else pa.int64()) for k, c in enumerate(columns)], names)

        held = 0
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = bpe.ids(text.as_py()) + end
                packer.add(len(docs), len(ids) // 4)
                docs.append((doc_id.as_py(), ids))
                held += len(ids) // 4
                if held >= window:
                    packer.fill()
                    yield flush()
                    still = {piece[0] for pieces in packer.open.values() for piece in pieces}
                    docs = [d if k in still else None for k, d in enumerate(docs)]
                    moved = {k: n for n, k in enumerate(sorted(still))}
                    docs = [d for d in docs if d is not None]
                    packer.open = {s: [(moved[d], a, b) for d, a, b in pieces] for s, pieces in packer.open.items()}
                    held = 0
        if docs:
            packer.fill()
            packer.rest()
            yield flush()
        docs.clear()
        pa.default_memory_pool().release_unused()  # the worker lives on for other stages

    return pack


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken", end_id: int = 1, length: int = 2048, window: int = 1 << 20) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece."""
    rows = docs.select("doc_id", text_of().alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_packing(tokenizer, ranks, end_id, length, window), f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
