"""Byte-level BPE vocabularies and a fast way through text: pieces between
blanks are encoded once per worker and looked up afterwards."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in JSON vocabularies:
    printable Latin-1 characters stand for themselves, the others follow from
    256 on in byte order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a ``.tiktoken`` file or a byte-level BPE JSON
    whose ids are merge ranks."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as lines:
            return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    with open(path, encoding="utf-8") as text:
        whole = json.load(text)
    special = {t["content"] for t in whole.get("added_tokens", ())}
    alphabet = byte_alphabet()
    return {bytes(alphabet[c] for c in token): rank
            for token, rank in whole["model"]["vocab"].items() if token not in special}


def special_tokens(path: str) -> dict[str, int]:
    """Special strings that the tokenizer of a JSON file finds inside texts."""
    with open(path, encoding="utf-8") as text:
        return {t["content"]: t["id"] for t in json.load(text).get("added_tokens", ())}


class BlankRun(Exception):
    """A blank followed by white space or by the end: the text can't be cut there."""


class Generations(dict):
    """A table of bounded size. At ``limit`` entries it becomes the older
    generation, of which only what is asked for again comes back."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.older = limit, {}

    def keep(self, key, value) -> None:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value

    def find(self, key):
        value = self.get(key)
        if value is None:
            value = self.older.get(key)
            if value is not None:
                self.keep(key, value)
        return value


class ChunkTable(Generations):
    """``encode`` remembered per chunk between two blanks.

    The split pattern of byte-level BPE gives a single blank to the word after
    it, so a text may be cut before each blank that a non-blank follows. Where
    a blank is followed by white space or by the end of the text, the whole
    text is encoded in one go instead.
    """

    def __init__(self, encode: Callable, join: Callable, limit: int = 100_000):
        super().__init__(limit)
        self.encode, self.join = encode, join

    def __missing__(self, chunk: str):
        if not chunk or chunk[0].isspace():
            raise BlankRun
        value = self.older.get(chunk)
        if value is None:
            value = self.encode(" " + chunk)
        if len(chunk) <= 48:
            self.keep(chunk, value)
        return value

    def __call__(self, text: str):
        first, *rest = text.split(" ")
        try:
            return self.join([self.encode(first), *map(self.__getitem__, rest)])
        except BlankRun:
            return self.join([self.encode(text)])


def packed(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.asarray(ids, "<u4").tobytes()


def library_encoder(path: str, pattern: str) -> Callable[[str], bytes]:
    """Packed ids of a text as the tokenizer of ``path`` gives them, special
    strings inside the text included."""
    import tiktoken

    specials = special_tokens(path) if path.endswith(".json") else {}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path),
                            special_tokens={})
    table = ChunkTable(lambda chunk: packed(own.encode_ordinary(chunk)) if chunk else b"", b"".join)

    def encode(text: str) -> bytes:
        for special, number in specials.items():
            if special in text:
                return packed([number]).join(encode(part) for part in text.split(special))
        return table(text)

    return encode


@lru_cache(maxsize=4)
def worker_encoder(path: str, pattern: str) -> Callable[[str], bytes]:
    """``library_encoder`` kept by the Python worker from task to task."""
    return library_encoder(path, pattern)
