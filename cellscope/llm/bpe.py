"""Byte-level BPE encoding and decoding by prefix dynamic programming.

Every byte prefix of a piece has exactly one BPE encoding, and its last token
is the only vocabulary token that ends there and may follow the last token of
the prefix before it. One id per prefix therefore stores the encodings of all
prefixes: appending extends the table, and an edit recomputes it only until it
agrees with the old one again.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import id_type, map_batches, slices, two_columns
from .tokens import ChunkTable, Generations, load_ranks


#: Chunks between blanks, and pieces of chunks, that a worker remembers at least,
#: and at most twice as many.
CHUNKS, PIECES = 300_000, 100_000


class Vocabulary:
    """Tokens and the rule which token may follow which."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.none = max(self.tokens, default=0) + 1
        self.last_merge = {rank: self.merge(token, until=2) for token, rank in ranks.items()}
        #: Tokens that merging builds from bytes: the others end no prefix.
        self.built = {token: rank for token, rank in ranks.items()
                      if len(token) == 1 or len(self.last_merge[rank]) == 2
                      and ranks.get(b"".join(self.tokens[p] for p in self.last_merge[rank])) == rank}
        #: By token * 256 + byte, the built token that is one byte longer (of no
        #: token: that byte).
        self.grown = {(self.built[token[:-1]] if token[1:] else self.none) << 8 | token[-1]: rank
                      for token, rank in self.built.items() if len(token) == 1 or token[:-1] in self.built}
        #: Whether each merge outranks the merges it needs; then merging goes
        #: through the ranks in order, which ``follows`` makes use of.
        self.ordered = all(max(self.last_merge[rank]) < rank for token, rank in self.built.items()
                           if len(token) > 1)
        self.verdicts: dict[tuple[int, int], bool] = {}
        self.heads = Generations(80_000)
        self._edges: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})

    def merge(self, data: bytes, until: int = 1) -> list[int]:
        """The definition: merge the adjacent pair of lowest rank, leftmost
        first, until no pair (or only ``until`` parts) is left."""
        parts = [data[i:i + 1] for i in range(len(data))]
        get, none = self.ranks.get, self.none
        found = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while found and len(parts) > until:
            rank = min(found)
            if rank == none:
                break
            at = found.index(rank)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at:
                found[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(found):
                found[at] = get(parts[at] + parts[at + 1], none)
        return [self.ranks[p] for p in parts]

    def edge(self, token: int, side: int) -> list[int]:
        """The parts that stand at the left (0) or right (1) end of a token
        while it is merged: from the single byte up to the token itself."""
        known = self._edges[side].get(token)
        if known is None:
            known = [token]
            while len(self.tokens[known[-1]]) > 1:
                known.append(self.last_merge[known[-1]][side])
            known = self._edges[side][token] = known[::-1]
        return known

    def follows(self, pair: tuple[int, int]) -> bool:
        """Whether merging the bytes of both gives back just these two: at no
        time is the pair across their border the next to be merged."""
        if len(self.verdicts) > 500_000:
            self.verdicts.clear()
        first, second = pair
        fits = self.verdicts[pair] = (
            self._border_holds(first, second) if self.ordered
            else self.merge(self.tokens[first] + self.tokens[second]) == [first, second])
        return fits

    def _border_holds(self, first: int, second: int) -> bool:
        left, right, tokens, none = self.edge(first, 1), self.edge(second, 0), self.tokens, self.none
        i = j = 0
        while True:
            across = self.ranks.get(tokens[left[i]] + tokens[right[j]], none)
            grow_left = left[i + 1] if i + 1 < len(left) else none
            grow_right = right[j + 1] if j + 1 < len(right) else none
            if across < grow_left and across <= grow_right and across != none:
                return False
            if grow_left == grow_right == none:
                return True
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1


class PrefixTable:
    """The encodings of all byte prefixes of one growing, editable piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"", last: Iterable[int] = ()):
        """``last`` may hold the tokens of the data's first prefixes, if known."""
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), list(last)
        self.append(data)

    def _extend(self, data: bytes, stop: int) -> None:
        """Stores the last tokens of the prefixes up to ``stop``. Only one token
        fits; as a rule it is the one before with one more byte (``grown``), or
        else short, so these are tried first."""
        v, last = self.vocabulary, self.last
        grown, get, known, follows = v.grown.get, v.built.get, v.verdicts.get, v.follows
        end, token = len(last), last[-1] if last else v.none
        start = end - v.size[token] if last else 0
        before = last[start - 1] if start else None
        for byte in data[end:stop]:
            end += 1
            longer = grown(token << 8 | byte)
            if longer is not None:
                fits = True
                if start:
                    pair = (before, longer)
                    fits = known(pair)
                    if fits is None:
                        fits = follows(pair)
                if fits:
                    token = longer
                    last.append(token)
                    continue
            start = end
            while True:
                start -= 1
                if start < 0:
                    raise ValueError(f"no token for byte {byte}")
                token = get(data[start:end])
                if token is None:
                    continue
                if not start:
                    break
                pair = (last[start - 1], token)
                fits = known(pair)
                if fits is None:
                    fits = follows(pair)
                if fits:
                    break
            before = last[start - 1] if start else None
            last.append(token)

    def append(self, more: bytes) -> None:
        """Exact at once: earlier prefixes keep their encodings."""
        self.data += more
        data = bytes(self.data)
        self._extend(data, len(data))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of bytes ``start:stop``; returns how many
        prefixes were encoded anew. Prefixes before the edit stay; after it,
        the old rest is taken over once as many consecutive prefixes agree as
        the longest token has bytes."""
        after = self.last[stop:]
        self.data[start:stop] = new
        data = bytes(self.data)
        del self.last[start:]
        resume, same = start + len(new), 0
        for end in range(start + 1, len(data) + 1):
            self._extend(data, end)
            if end > resume:
                same = same + 1 if after[end - resume - 1] == self.last[-1] else 0
                if same >= self.vocabulary.longest:
                    self.last += after[end - resume:]
                    return end - start
        return len(data) - start

    def ids(self) -> list[int]:
        """Read back from the end: one step per token."""
        found, end, last, size = [], len(self.last), self.last, self.vocabulary.size
        while end:
            token = last[end - 1]
            found.append(token)
            end -= size[token]
        return found[::-1]


def encode_piece(vocabulary: Vocabulary, piece: bytes) -> list[int]:
    """One match of the split pattern; a piece that is itself a token is that
    token, as the reference library has it. The prefix tables of common piece
    beginnings are kept and appended to."""
    token = vocabulary.ranks.get(piece)
    if token is not None:
        return [token]
    heads = vocabulary.heads
    last = heads.find(piece[:8]) or heads.find(piece[:4]) or ()
    table = PrefixTable(vocabulary, piece, last)
    for size in (4, 8):
        if len(last) < size <= len(piece):
            heads.keep(piece[:size], tuple(table.last[:size]))
    return table.ids()


def packed_few(ids: list[int]) -> bytes:
    """``packed`` of a piece's ids, without making an array."""
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def worker_vocabulary(path: str) -> Vocabulary:
    return Vocabulary(load_ranks(path))


@lru_cache(maxsize=2)
def worker_table(path: str, pattern: str) -> ChunkTable:
    import regex

    vocabulary, pieces = worker_vocabulary(path), regex.compile(pattern).findall
    known = Generations(PIECES)

    def ids(piece: str) -> bytes:
        found = known.find(piece)
        if found is None:
            found = packed_few(encode_piece(vocabulary, piece.encode()))
            if len(piece) <= 32:
                known.keep(piece, found)
        return found

    def chunk_ids(chunk: str) -> bytes:
        # A blank and ASCII letters are one match, which the chunk table keeps.
        if chunk[:1] == " " and chunk.isascii() and chunk[1:].isalpha():
            return packed_few(encode_piece(vocabulary, chunk.encode()))
        return b"".join(map(ids, pieces(chunk)))

    return ChunkTable(chunk_ids, b"".join, CHUNKS)


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, ids (packed little-endian
    unsigned 32-bit). Null and empty text: no ids. Repeated rows and null ids
    give a row each; other columns are not read. Row by row, no shuffle."""
    def work(batches):
        table = worker_table(ranks_path, pattern)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            yield {"doc_id": batch.column("doc_id"), "n_bytes": [len(t.encode()) for t in texts],
                   "ids": [table(t) for t in texts]}

    return map_batches(two_columns(df, id_col, text_col), work,
                       f"doc_id {id_type(df, id_col)}, n_bytes long, ids binary")


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` (bytes) to doc_id and ids. Null ids: no bytes."""
    from pyspark.sql import functions as F

    def work(batches):
        tokens = worker_vocabulary(ranks_path).tokens.__getitem__
        for batch in batches:
            step = 500
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                ids = [np.frombuffer(x or b"", "<u4").tolist() for x in part.column("ids").to_pylist()]
                yield {"doc_id": part.column("doc_id"), "ids": part.column("ids"),
                       "decoded": [b"".join(map(tokens, x)) for x in ids]}

    return map_batches(df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")), work,
                       f"doc_id {id_type(df, id_col)}, ids binary, decoded binary")
