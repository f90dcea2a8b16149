"""Operator 6: byte-level BPE encoding and decoding.

A piece of text is a doubly linked list of symbols; a priority queue holds the rank of every mergeable
neighbour pair, and entries that a former merge has made stale are skipped. Decoding concatenates the
byte strings of the vocabulary.

Defined cases: a null text is encoded as the empty text (no ids); ties of rank are merged left to right;
a text may have any length; repeated rows give repeated results; columns of the input are never read but
for the id and the text, so extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.shared import in_python

#: The split pattern of byte-level BPE vocabularies of this kind.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Pieces that a worker keeps the ids of; twice as many where the older generation counts. An entry of a short Latin
#: piece takes about 160 bytes, so a worker's tables take up to 42 MB of such.
CACHED_PIECES = 130_000
#: Longer pieces are not kept, so that entries stay small.
LONGEST_CACHED = 64


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte: itself if printable in Latin-1, else the next character from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def latin_split() -> str:
    """``SPLIT`` for texts of Latin-1 characters, its classes spelled out: `re` has none by property, but takes half the time."""
    chars = [chr(i) for i in range(256)]
    letters, numbers, spaces = ("".join(re.escape(c) for c in chars if regex.match(p, c)) for p in (r"\p{L}", r"\p{N}", r"\p{White_Space}"))
    spelled = SPLIT.replace(r"[^\p{White_Space}\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\P{White_Space}", f"[^{spaces}]")
    return spelled.replace(r"\p{White_Space}", f"[{spaces}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")


class _Cache(dict):
    """Ids of pieces in two generations: the older one goes when the younger one is full."""

    def __init__(self, compute, size: int):
        super().__init__()
        self.compute, self.size, self.older = compute, size, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = self.compute(piece)
        if len(piece) <= LONGEST_CACHED:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found

    def forget(self) -> None:
        self.clear()
        self.older = {}


class Bpe:
    """Encoder and decoder of one vocabulary file; holds tables only, so a worker builds it once."""

    def __init__(self, path: str, cached: int = CACHED_PIECES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.first = [0] * 256
        for char, byte in alphabet.items():
            self.first[byte] = vocab[char]
        right_of: dict[int, dict[int, int]] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            right_of.setdefault(vocab[left], {})[vocab[right]] = rank
            self.merged.append(vocab[left + right])
        #: For every symbol a look-up of the rank of its pair with the next symbol, None if the pair is not mergeable.
        self.rank_after = [{}.get] * (max(vocab.values()) + 1)
        for left, ranks in right_of.items():
            self.rank_after[left] = ranks.get
        self.byte_ranks = [[self.rank_after[a](b) for b in self.first] for a in self.first]
        self.bytes_of = {i: bytes(alphabet[c] for c in token) for token, i in vocab.items()}
        self.bytes_of |= {i: content.encode() for content, i in special.items()}
        self.id_text = [b"%d" % i for i in range(max(self.bytes_of) + 1)]
        self.bytes_of_text = {self.id_text[i]: b for i, b in self.bytes_of.items()}
        self.special = special
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split, self.split_latin = regex.compile(SPLIT).findall, re.compile(latin_split()).findall
        self.is_latin = re.compile("[\0-\xff]*").fullmatch
        self.pieces = _Cache(lambda piece: b",".join([self.id_text[i] for i in self.merge(piece.encode())]), cached)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        n, made, rank_after = len(piece), self.merged, self.rank_after
        now = [ranks[b] for ranks, b in zip(map(self.byte_ranks.__getitem__, piece), piece[1:])]  # rank of the pair that starts here
        shift = n.bit_length()  # entries of short pieces stay small numbers
        queue = [r << shift | i for i, r in enumerate(now) if r is not None]
        symbols = [self.first[b] for b in piece]
        if not queue:
            return symbols
        now.append(None)
        after, before, place = list(range(1, n + 1)), list(range(-1, n - 1)), (1 << shift) - 1
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            r, i = entry >> shift, entry & place
            if now[i] != r:
                continue  # stale: a symbol of the pair has been merged since
            j = after[i]
            after[i] = k = after[j]
            symbols[i] = left = made[r]
            symbols[j] = now[j] = now[i] = None
            if k < n:
                before[k] = i
                now[i] = r = rank_after[left](symbols[k])
                if r is not None:
                    push(queue, r << shift | i)
            if i:
                h = before[i]
                now[h] = r = rank_after[symbols[h]](left)
                if r is not None:
                    push(queue, r << shift | h)
        return [s for s in symbols if s is not None]

    def _parts(self, text: str) -> bytes:
        """Ids of a stretch of text without special tokens, joined by commas."""
        split = self.split_latin if self.is_latin(text) else self.split
        return b",".join(map(self.pieces.__getitem__, split(text)))

    def encode_joined(self, text: str) -> bytes:
        """Decimal ids of a text, special tokens included, joined by commas."""
        if self.at_special is None or not self.at_special.search(text):
            return self._parts(text)
        out, start = [], 0
        for m in self.at_special.finditer(text):
            out += [self._parts(text[start : m.start()]), self.id_text[self.special[m[0]]]]
            start = m.end()
        return b",".join(filter(None, [*out, self._parts(text[start:])]))

    def encode(self, text: str) -> list[int]:
        joined = self.encode_joined(text)
        return [int(i) for i in joined.split(b",")] if joined else []

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; byte sequences that are not UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def decode_joined(self, joined: bytes) -> bytes:
        return b"".join(map(self.bytes_of_text.__getitem__, joined.split(b","))) if joined else b""


_loaded: dict[str, Bpe] = {}


@contextmanager
def _of_task(path: str) -> Iterator[Bpe]:
    """The vocabulary's encoder for one task: a worker keeps its tables for the next one, but no cached pieces."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    bpe = _loaded[path]
    try:
        yield bpe
    finally:
        bpe.pieces.forget()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with _of_task(path) as bpe:
            for batch in batches:
                yield pd.DataFrame({id_col: batch["id"], "ids": [bpe.encode(t or "") for t in batch["text"]]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return in_python(rows, run, f"`{id_col}` long, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of every array of ids; null ids give the empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with _of_task(path) as bpe:
            for batch in batches:
                yield pd.DataFrame({id_col: batch["id"], "text": [bpe.decode(() if i is None else map(int, i)) for i in batch["ids"]]})

    return in_python(encoded.select(F.col(id_col).cast("long").alias("id"), "ids"), run, f"`{id_col}` long, text string")


def _digests(bpe: Bpe, text: str) -> tuple[int, str, str]:
    """Number of ids of a text, digest of the ids, and digest of the text that they decode to."""
    joined = bpe.encode_joined(text)
    decoded = bpe.decode_joined(joined).decode("utf-8", "replace")
    return joined.count(b",") + 1 if joined else 0, hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode every text, decode its ids, and return count and digests of both; ``keep`` columns follow.

    Ids stay within a task, so nothing of the size of the ids is shuffled or stored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with _of_task(path) as bpe:
            for batch in batches:
                digested = [_digests(bpe, text or "") for text in batch["text"]]
                out = pd.DataFrame(digested, columns=["n_tokens", "ids_sha256", "decoded_sha256"], index=batch.index)
                out.insert(0, id_col, batch["id"])
                for i, name in enumerate(keep):
                    out[name] = batch[f"keep{i}"]
                yield out

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)))
    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return in_python(rows, run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string{kept}")
