"""Byte-level BPE encoding and decoding without running the merges.

Bytes are mapped to Latin-1 characters, as the Aho-Corasick library's trie
takes strings. From the trie's longest entry at each place the encoder goes
left to right and backtracks: a token may follow another
only if the merges would leave exactly this pair side by side, which is decided
by undoing the merges along their common border and remembered. Places proven
dead are never tried again, so the work is linear in the piece.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: The rank file; a path that the driver can read.
RANKS_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Bytes of pieces and ids that a worker remembers (the older half goes when they are reached), the length of a piece
#: from which it is not, and the pairs of tokens remembered; bounds memory only.
CACHED_BYTES, LONG_PIECE, CACHED_PAIRS = 24 << 20, 64, 200_000
#: What a remembered piece takes beside its characters and ids.
ENTRY_BYTES = 190
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Splitter:
    """Cuts texts into pieces by a tokenizer's pattern.

    The pattern's Unicode classes are spelled out as the ranges that the
    tokenizer library itself gives them, since other libraries follow other
    versions of Unicode. Texts of the first ``LOW`` code points, nearly all of
    Latin script, use the same pattern with the ranges below it."""

    LOW = 0x250

    def __init__(self, pattern: str):
        classes = {name: self._members(name) for name in (r"\p{L}", r"\p{N}", r"\s")}
        self.full = re.compile(self._spelled(pattern, classes, 0x110000))
        self.low = re.compile(self._spelled(pattern, classes, self.LOW))
        self.high = re.compile(f"[^\0-{chr(self.LOW - 1)}]")

    @staticmethod
    def _members(name: str) -> list[int]:
        one_byte = tiktoken.Encoding("bytes", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        return sorted(map(ord, bytes(one_byte.encode_ordinary(every)).decode()))

    @staticmethod
    def _spelled(pattern: str, classes: dict[str, list[int]], below: int) -> str:
        inner = {}
        for name, members in classes.items():
            runs: list[list[int]] = []
            for c in members:
                if c >= below:
                    break
                if runs and runs[-1][1] == c - 1:
                    runs[-1][1] = c
                else:
                    runs.append([c, c])
            inner[name] = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)
        inner[r"\S"] = "^" + inner[r"\s"]
        # a class inside brackets becomes its ranges, one outside a set of its own
        out, bracket, i = [], False, 0
        while i < len(pattern):
            name = next((n for n in inner if pattern.startswith(n, i)), None)
            if name:
                out.append(inner[name] if bracket else f"[{inner[name]}]")
                i += len(name)
            else:
                bracket = pattern[i] == "[" or bracket and pattern[i] != "]"
                out.append(pattern[i])
                i += 1
        return "".join(out)

    def __call__(self, text: str) -> list[str]:
        return (self.full if self.high.search(text) else self.low).findall(text)


class Encoder:
    """Encodes byte strings of single pieces as the merges in ``ranks`` would."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.split = Splitter(pattern)
        # The two parts whose merge makes each token; bytes have none. Entries
        # that merging never makes are matched as whole pieces only.
        self.parts = {i: self._last_merge(b) for b, i in ranks.items() if len(b) > 1}
        self.entry = {b.decode("latin-1"): i for b, i in ranks.items() if len(b) == 1 or self.parts[i]}
        self.trie = ahocorasick.Automaton()
        for word, i in self.entry.items():
            self.trie.add_word(word, i)
        self.reach = max(map(len, self.entry))
        self.size = {i: len(b) for i, b in self.token.items()}
        self.decimal = {i: str(i) for i in self.token}
        self.shorter: dict[int, int | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        #: Type code of an id: as narrow as the vocabulary allows.
        self.code = "H" if max(self.token, default=0) < 1 << 16 else "I"
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _last_merge(self, word: bytes) -> tuple[int, int] | None:
        pieces = [word[i:i + 1] for i in range(len(word))]
        while len(pieces) > 2:
            options = [(r, i) for i in range(len(pieces) - 1)
                       if (r := self.ranks.get(pieces[i] + pieces[i + 1])) is not None]
            if not options:
                return None
            _, i = min(options)
            pieces[i:i + 2] = [pieces[i] + pieces[i + 1]]
        return tuple(self.ranks[p] for p in pieces) if len(pieces) == 2 else None

    def _entry_below(self, ahead: str, n: int) -> int:
        while (token := self.entry.get(ahead[:n])) is None:
            n -= 1
        return token

    def _next_shorter(self, token: int) -> int | None:
        """The longest other entry that the token begins with."""
        if token not in self.shorter:
            word = self.token[token].decode("latin-1")
            self.shorter[token] = next((i for n in range(len(word) - 1, 0, -1)
                                        if (i := self.entry.get(word[:n])) is not None), None)
        return self.shorter[token]

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging leaves the two tokens side by side.

        Time runs backwards: the later of the two tokens' own merges is undone
        first. Whenever the tokens at the border could merge with a rank before
        that of the merge undone last, merging would have joined them."""
        known = self.fits.get((left, right))
        if known is not None:
            return known
        a, b, undone = left, right, (float("inf"), 0)
        while True:
            joined = self.ranks.get(self.token[a] + self.token[b])
            if joined is not None and (joined, 0.5) < undone:
                ok = False
                break
            # equal ranks merge from left to right: the left token's merge (0) comes
            # before one across the border (0.5), and that before the right token's (1)
            times = [(t, side) for t, side in ((a, 0), (b, 1)) if self.parts.get(t)]
            if not times:
                ok = True
                break
            undone = max(times)
            if undone[1]:
                b = self.parts[b][0]
            else:
                a = self.parts[a][1]
        self.fits[left, right] = ok
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, word = len(piece), piece.decode("latin-1")
        dead: set[int] = set()
        out: list[int] = []
        size, fits, entry, longest, reach = self.size, self.fits, self.entry, self.trie.longest_prefix, self.reach
        at = last = 0
        while at < n:
            # the longest entry from here: the trie's longest path, less what is no entry
            ahead = word[at:at + reach] if at or n > reach else word
            far = longest(ahead)
            token = entry.get(ahead[:far])
            if token is None:
                token = self._entry_below(ahead, far)
            while at + size[token] in dead or out and not (
                    fits[last, token] if (last, token) in fits else self._fits(last, token)):
                smaller = self._next_shorter(token)
                while smaller is None:  # nothing fits from here: never come back
                    dead.add(at)
                    at -= size[last]
                    smaller = self._next_shorter(out.pop())
                    last = out[-1] if out else 0
                token = smaller
            out.append(token)
            last = token
            at += size[token]
        return out

    def encode(self, text: str) -> list[int]:
        return self.ids(text).tolist()

    def ids(self, text: str) -> array:
        out = array(self.code)
        known, add = self.known, out.frombytes
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = array(self.code, self.encode_piece(piece.encode())).tobytes()
                if len(piece) < LONG_PIECE:
                    self._remember(piece, ids)
            add(ids)
        return out

    def _remember(self, piece: str, ids: bytes) -> None:
        if self.held >= CACHED_BYTES:
            for old in list(islice(self.known, len(self.known) // 2)):
                self.held -= len(old) + len(self.known.pop(old)) + ENTRY_BYTES
            if len(self.fits) >= CACHED_PAIRS:
                self.fits.clear()
        self.known[piece] = ids
        self.held += len(piece) + len(ids) + ENTRY_BYTES

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_encoders: dict[str, Encoder] = {}


def _encoder(ranks) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    key = str(ranks.id if hasattr(ranks, "id") else id(ranks))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks.value)
    return _encoders[key]


def encode(docs: DataFrame, ranks_file: str = RANKS_FILE, *, id_col: str = "doc_id", text_col: str = "text",
           digest: bool = False) -> DataFrame:
    """(doc_id, ids array, decoded binary) of every text, or their digests.

    A null text is an empty one: no ids. Null ids, ties and repeated rows give
    a row each; other columns are ignored. The vocabulary (a fixed file, about
    a megabyte) is read on the driver and broadcast; texts never move."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_file))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks)
        for batch in slices(batches):
            out = []
            for text in batch.column(1).to_pylist():
                ids = encoder.ids(text or "")
                back = encoder.decode(ids)
                out.append((len(ids), hashlib.sha256(" ".join(map(encoder.decimal.__getitem__, ids)).encode()).hexdigest(),
                            hashlib.sha256(back).hexdigest()) if digest else (np.frombuffer(ids, ids.typecode), back))
            told = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *told], names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "ids", "decoded"]
    types = [pa.int64(), pa.string(), pa.string()] if digest else [pa.list_(pa.int32()), pa.binary()]
    schema = RESULT if digest else "doc_id long, ids array<int>, decoded binary"
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(rows, schema)


def digests(docs: DataFrame, ranks_file: str = RANKS_FILE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space) and
    decoded_sha256 (of the decoded bytes)."""
    return encode(docs, ranks_file, digest=True)
