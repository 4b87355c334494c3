"""Harmonic packing of documents into fixed-length token sequences.

Class ``j`` holds the pieces longer than capacity / (j + 1) and at most
capacity / j; each of its bins takes exactly ``j`` of them. Documents may be
cut, so they are cut where classes waste nothing: whole sequences, then halves,
quarters, ... down to ``min_piece``, and one short tail, of whose class each bin
is at least j / (j + 1) full. Every task packs its own documents; nothing is
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import id_type, map_batches, partition_number, slices, two_columns
from .tokens import packed, worker_encoder

FIELDS = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def cut_lengths(total: int, capacity: int, min_piece: int) -> Iterator[int]:
    """Whole sequences, then falling halves of the capacity, then the tail."""
    for _ in range(total // capacity):
        yield capacity
    rest, half = total % capacity, capacity
    while half > min_piece and half % 2 == 0:
        half //= 2
        if rest >= half:
            yield half
            rest -= half
    if rest:
        yield rest


class Packer:
    """One task's bins. A bin's pieces are held until its count is complete,
    so at most one bin per class is in memory."""

    def __init__(self, capacity: int, min_piece: int, first_sequence: int):
        self.capacity, self.min_piece, self.next = capacity, min_piece, first_sequence
        self.open: dict[int, list[tuple]] = {}

    def _place(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids) // 4, ids, total, self.next, offset
            offset += len(ids) // 4
        self.next += 1

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        start, total = 0, len(ids) // 4
        for length in cut_lengths(total, self.capacity, self.min_piece):
            count = self.capacity // length
            pieces = self.open.setdefault(count, [])
            pieces.append((doc, start, ids[4 * start:4 * (start + length)], total))
            start += length
            if len(pieces) == count:
                yield from self._place(self.open.pop(count))

    def finish(self) -> Iterator[tuple]:
        """The pieces of bins that stayed incomplete are strung together and cut
        into whole sequences, the rest into sequences of powers of two."""
        rest = [piece for count in sorted(self.open) for piece in self.open[count]]
        left = sum(len(p[2]) // 4 for p in rest)
        while left:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= room
            bin_pieces = []
            while room:
                doc, start, ids, total = rest.pop(0)
                size = min(room, len(ids) // 4)
                bin_pieces.append((doc, start, ids[:4 * size], total))
                if size < len(ids) // 4:
                    rest.insert(0, (doc, start + size, ids[4 * size:], total))
                room -= size
            yield from self._place(bin_pieces)
        self.open.clear()


def pack(df: DataFrame, tokenizer_path: str, pattern: str, capacity: int = 2048, end_id: int = 1,
         min_piece: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (packed little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its token ids and ``end_id``; null or empty text is the end
    id alone. Repeated rows and null ids are packed like any other row; other
    columns are not read. A sequence_id holds the partition number above its
    lower 40 bits, so tasks number independently.
    """
    if not 1 <= min_piece <= capacity:
        raise ValueError("min_piece must lie between 1 and the capacity")
    end = packed([end_id])

    def work(batches):
        encode = worker_encoder(tokenizer_path, pattern)
        packer = Packer(capacity, min_piece, partition_number() << 40)
        rows: list[tuple] = []
        held = 0
        for batch in slices(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for row in packer.add(doc, encode(text) + end):
                    rows.append(row)
                    held += row[2]
                    if held >= 1 << 20:
                        yield dict(zip(FIELDS, zip(*rows)))
                        rows, held = [], 0
        rows += packer.finish()
        if rows:
            yield dict(zip(FIELDS, zip(*rows)))

    return map_batches(two_columns(df, id_col, text_col), work,
                       f"doc_id {id_type(df, id_col)}, start long, length long, ids binary, "
                       "doc_tokens long, sequence_id long, offset long")
