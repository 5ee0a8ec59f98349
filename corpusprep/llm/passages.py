"""Repeated passages removed, as a suffix array would find them.

Every place of every text belongs to a bucket of places whose next bytes are
equal. Buckets start from short strings (q-grams) and are refined by the bucket
identifiers of later offsets: a bucket of 32 bytes is a pair of 16-byte buckets
16 apart, one of 50 bytes a pair of 32-byte buckets 18 apart, so each
refinement reuses the one before. Identifiers are hashes of the content, the
same in every task, and sorting them brings equal strings together.

Not every place is sorted. Of the 32-byte places inside each 50-byte string the
one of least identifier is chosen; equal strings choose alike. Only strings
whose chosen place falls into a bucket with two texts are refined to 50 bytes
and sorted, so most of the corpus never leaves its chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a repeated string, of the first buckets, and of those that places are chosen by.
LENGTH, GRAM, MIDDLE = 50, 16, 32
WINDOW = LENGTH - MIDDLE + 1
#: Bytes of text in a chunk (a group of texts that one task handles) and at once.
CHUNK, BATCH = 4 << 20, 1 << 20
#: Order of null ids: after all others.
LAST = 2**63 - 1

_EMPTY = hashlib.sha256(b"").hexdigest()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The identifier of a bucket refined by that of a later offset."""
    return _mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def _slide(f, a: np.ndarray, width: int) -> np.ndarray:
    """f over every ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        a = f(a[:-size], a[size:])
        size *= 2
    return f(a[:size - width], a[width - size:]) if size < width else a


def middles(buffer: bytes) -> np.ndarray:
    """The 32-byte bucket of every place (the last 31 have none)."""
    eight = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
    gram = _pair(_mix(eight[:-8].astype(np.uint64)), eight[8:].astype(np.uint64))
    return _pair(gram[:-GRAM], gram[GRAM:])


class Batch:
    """Neighbouring pieces of texts: a string belongs to the piece it starts in."""

    def __init__(self, pieces: list[tuple[int, int, bytes]]):
        self.buffer = b"".join(p for _, _, p in pieces)
        sizes = np.array([len(p) for _, _, p in pieces])
        starts = np.cumsum(sizes) - sizes
        self.middle = middles(self.buffer)
        self.key = (self.middle >> np.uint64(32)).astype(np.uint32)
        self.least = _slide(np.minimum, self.key, WINDOW)  # by start of a string
        counts = sizes - LENGTH + 1
        self.at = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        self.text = np.repeat([i for i, _, _ in pieces], counts)
        self.place = self.at + np.repeat([offset for _, offset, _ in pieces] - starts, counts)
        held = np.zeros(len(self.middle) + WINDOW - 1, np.uint32)
        held[self.at + WINDOW - 1] = self.least[self.at]
        self.chosen = np.flatnonzero(_slide(np.maximum, np.append(held, np.zeros(WINDOW - 1, np.uint32)), WINDOW)[:len(self.key)] == self.key)

    def candidates(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(50-byte bucket, text, place) of the strings whose least place is one of ``shared``, chosen places."""
        if not len(shared):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = np.full(len(self.key), 0xFFFFFFFF, np.uint32)
        near[shared] = self.key[shared]
        some = np.zeros(len(self.key) + WINDOW, np.int32)  # whether a shared place is inside at all
        some[shared + 1] = 1
        some = np.cumsum(some)
        own = _slide(np.minimum, near, WINDOW)[self.at] == self.least[self.at]
        own &= some[self.at + WINDOW] > some[self.at]
        at = self.at[own]
        return _pair(self.middle[at], self.middle[at + LENGTH - MIDDLE]), self.text[own], self.place[own]


class Chunk:
    """The texts of a chunk in order of their first id, and its requests."""

    def __init__(self, rows: pd.DataFrame, buckets: int):
        self.buckets = np.uint64(buckets)
        first = rows.groupby("key", sort=True).agg(ord=("ord", "min"), z=("z", "first")).reset_index().sort_values(["ord", "key"])
        self.keys, self.order, self.z = first["key"].tolist(), first["ord"].to_numpy(np.int64), first["z"].tolist()
        self._middle: tuple | None = None

    def text(self, i: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(bytes(self.z[i]))

    def batches(self) -> Iterator[Batch]:
        pieces, size = [], 0
        for i in range(len(self.z)):
            text = self.text(i)
            for offset in range(0, max(len(text) - LENGTH + 1, 0), BATCH):
                piece = text[offset:offset + BATCH + LENGTH - 1]
                if pieces and size + len(piece) > BATCH:
                    yield Batch(pieces)
                    pieces, size = [], 0
                pieces.append((i, offset, piece))
                size += len(piece)
        if pieces:
            yield Batch(pieces)

    def middle_request(self) -> tuple[np.ndarray, np.ndarray]:
        """The chosen buckets, as (request bucket, 32 bits) in one number, in
        order, and whether two texts of the chunk are in them."""
        names, texts = [], []
        for b in self.batches():
            # a chosen place's text: that of the last string that starts at or before it
            holder = b.text[np.maximum(np.searchsorted(b.at, b.chosen, side="right") - 1, 0)]
            names.append(self._named(b.middle[b.chosen]))
            texts.append(holder)
        if not names:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        name, text = np.concatenate(names), np.concatenate(texts)
        distinct, which = np.unique(name, return_inverse=True)
        low, high = np.full(len(distinct), 2**62), np.full(len(distinct), -1)
        np.minimum.at(low, which, text)
        np.maximum.at(high, which, text)
        return distinct, low != high

    def _named(self, middle: np.ndarray) -> np.ndarray:
        return ((middle >> np.uint64(32)) % self.buckets) << np.uint64(32) | middle & np.uint64(0xFFFFFFFF)

    def strings(self, answers: dict[int, bytes]):
        """All candidate strings: (bucket, text, place), given the answers to the middle request."""
        distinct, twice = self.middle_request()
        shared = distinct[_bits(distinct >> np.uint64(32), answers, len(distinct))]
        parts = []
        for b in self.batches():
            name = self._named(b.middle[b.chosen])
            at = np.minimum(np.searchsorted(shared, name), max(len(shared) - 1, 0))
            parts.append(b.candidates(b.chosen[shared[at] == name] if len(shared) else b.chosen[:0]))
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def string_request(self, bucket: np.ndarray, text: np.ndarray):
        """Distinct strings in order of (request bucket, text, name), with the
        first text of each in the chunk, and which of them each string is."""
        distinct, first, which = np.unique(bucket, return_index=True, return_inverse=True)
        home, holder = (distinct >> np.uint64(32)) % self.buckets, text[first]
        order = np.lexsort((distinct, holder, home))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return distinct[order], holder[order], home[order], back[which]


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values, and the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.append(np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])), len(sorted_values))


def _bits(home: np.ndarray, answers: dict[int, bytes], n: int) -> np.ndarray:
    """Answers in the order of the request, whose buckets come in runs."""
    out = np.zeros(n, bool)
    runs = _runs(home)
    for a, b in zip(runs[:-1], runs[1:], strict=True):
        out[a:b] = np.unpackbits(np.frombuffer(answers[int(home[a])], np.uint8), count=b - a).astype(bool)
    return out


REQUEST = "chunk long, bucket long, payload binary"
ANSWER = "chunk long, bucket long, level int, bits binary"


def _ask_middles(buckets: int):
    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        chunk = int(rows["chunk"].iloc[0])
        names, twice = Chunk(rows, buckets).middle_request()
        runs, out = _runs(names >> np.uint64(32)), []
        for a, b in zip(runs[:-1], runs[1:], strict=True):
            payload = names[a:b].astype("<u4").tobytes() + np.packbits(twice[a:b]).tobytes()
            out.append((chunk, int(names[a] >> np.uint64(32)), payload))
        return pd.DataFrame(out, columns=["chunk", "bucket", "payload"])
    return ask


def _answer_middles(rows: pd.DataFrame) -> pd.DataFrame:
    """For every name, whether two texts have it."""
    names, twice, sizes = [], [], []
    for payload in rows["payload"]:
        n = (8 * len(payload)) // 33
        names.append(np.frombuffer(payload, "<u4", n))
        twice.append(np.unpackbits(np.frombuffer(payload, np.uint8, offset=4 * n), count=n).astype(bool))
        sizes.append(n)
    name = np.concatenate(names)
    _, which, count = np.unique(name, return_inverse=True, return_counts=True)
    shared = (count[which] > 1) | np.concatenate(twice)
    return _told(rows, shared, sizes, 1)


def _told(rows: pd.DataFrame, bits: np.ndarray, sizes: list[int], level: int) -> pd.DataFrame:
    ends = np.cumsum(sizes)
    return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "level": level,
                         "bits": [np.packbits(bits[e - n:e]).tobytes() for n, e in zip(sizes, ends, strict=True)]})


def _answers(rows: pd.DataFrame, level: int) -> dict[int, bytes]:
    mine = rows[rows["level"] == level]
    return dict(zip(mine["bucket"].astype(int), map(bytes, mine["bits"]), strict=True))


def _ask_strings(buckets: int):
    def ask(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(texts):
            number, chunk = int(texts["chunk"].iloc[0]), Chunk(texts, buckets)
            bucket, text, _ = chunk.strings(_answers(answers, 1))
            names, holder, home, _ = chunk.string_request(bucket, text)
            runs = _runs(home)
            for a, b in zip(runs[:-1], runs[1:], strict=True):
                own = _runs(holder[a:b])
                orders, counts = chunk.order[holder[a:b][own[:-1]]], np.diff(own)
                head = zstandard.ZstdCompressor(1).compress(np.diff(orders, prepend=0).astype("<i8").tobytes() + counts.astype("<i8").tobytes())
                low = names[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()
                out.append((number, int(home[a]), len(head).to_bytes(4, "little") + head + low))
        return pd.DataFrame(out, columns=["chunk", "bucket", "payload"])
    return ask


def _answer_strings(rows: pd.DataFrame) -> pd.DataFrame:
    """For every string of a chunk, whether a text before the chunk's first one has it."""
    names, orders, sizes = [], [], []
    for payload in rows["payload"]:
        payload = bytes(payload)
        n = int.from_bytes(payload[:4], "little")
        head = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload[4:4 + n]), "<i8")
        low = np.frombuffer(payload, np.uint8, offset=4 + n).reshape(-1, 7)
        wide = np.zeros((len(low), 8), np.uint8)
        wide[:, :7] = low
        names.append(wide.view("<u8").ravel())
        half = len(head) // 2
        orders.append(np.repeat(np.cumsum(head[:half]), head[half:]))
        sizes.append(len(low))
    name, order = np.concatenate(names), np.concatenate(orders)
    by = np.argsort(name, kind="stable")
    runs = _runs(name[by])
    least = np.repeat(np.minimum.reduceat(order[by], runs[:-1]), np.diff(runs)) if len(by) else order
    later = np.zeros(len(by), bool)
    later[by] = order[by] > least
    return _told(rows, later, sizes, 2)


def _cut(buckets: int, keep_text: bool):
    def cut(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(texts):
            chunk = Chunk(texts, buckets)
            bucket, text, place = chunk.strings(_answers(answers, 1))
            names, holder, home, which = chunk.string_request(bucket, text)
            elsewhere = _bits(home, _answers(answers, 2), len(home))
            later = elsewhere[which] | (chunk.order[text] > chunk.order[holder[which]])
            text, place = text[later], place[later]
            by = np.lexsort((place, text))
            text, place = text[by], place[by]
            starts = np.searchsorted(text, np.arange(len(chunk.keys) + 1))
            for i, key in enumerate(chunk.keys):
                data, p = chunk.text(i), place[starts[i]:starts[i + 1]]
                spans = []
                if len(p):
                    breaks = np.flatnonzero(p[1:] > p[:-1] + LENGTH)
                    spans = list(zip(p[np.append(0, breaks + 1)].tolist(), (p[np.append(breaks, len(p) - 1)] + LENGTH).tolist(), strict=True))
                left, end = [], 0
                for a, b in spans:
                    left.append(data[end:a])
                    end = b
                kept = b"".join([*left, data[end:]])
                out.append((key, int(chunk.order[i]), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if keep_text else None))
        return pd.DataFrame(out, columns=["key", "first", "n_removed", "n_spans", "kept_sha256", "kept"])
    return cut


def _first_texts(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every text of a task once, compressed, with the least order of its copies."""
    seen: dict[str, int] = {}
    lower: dict[str, tuple[int, int]] = {}
    pack = zstandard.ZstdCompressor(3)
    for batch in rows:
        out = []
        for chunk, key, order, text in zip(batch["chunk"], batch["key"], batch["ord"], batch["text"], strict=True):
            if key not in seen:
                out.append((chunk, key, order, pack.compress(text.encode())))
                seen[key] = order
            elif order < seen[key]:
                seen[key] = order
                lower[key] = (chunk, order)
        yield pd.DataFrame(out, columns=["chunk", "key", "ord", "z"])
    yield pd.DataFrame([(c, k, o, None) for k, (c, o) in lower.items()], columns=["chunk", "key", "ord", "z"])


def passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``doc`` (the row's columns but its text), ``n_bytes``, ``n_removed``,
    ``n_spans``, ``kept_sha256`` (of the bytes that stay) and, if asked for,
    ``kept``: these bytes as text, less characters that lost a part.

    A byte goes if it is covered by a string of LENGTH bytes that also starts
    in a document of smaller id; strings are judged on the input. Null texts
    are empty; null ids come after all others and are not smaller than one
    another; rows of one id are not smaller than each other; a copy of an
    earlier text loses all bytes if it has LENGTH of them. An empty table gives
    no rows.

    Every different text is handled once, in a chunk named by its hash. Chunks
    ask other tasks about the buckets that they hold, each once however many
    texts share it, so a passage in a third of all texts costs a row for each
    chunk. Texts move once; the exchange serves all three passes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = max(1, -(-int(total) // CHUNK))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others).alias("doc"), F.coalesce(F.col(id_col), F.lit(LAST)).alias("ord"), F.md5(text.cast("binary")).alias("key"),
                       F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    texts = (rows.select(F.pmod(F.xxhash64("key"), F.lit(chunks)).alias("chunk"), "key", "ord", "text")
             .mapInPandas(_first_texts, "chunk long, key string, ord long, z binary"))
    here = lambda: texts.groupBy("chunk")
    middles_asked = here().applyInPandas(_ask_middles(chunks), REQUEST)
    first = middles_asked.groupBy("bucket").applyInPandas(_answer_middles, ANSWER)
    strings_asked = here().cogroup(first.groupBy("chunk")).applyInPandas(_ask_strings(chunks), REQUEST)
    second = strings_asked.groupBy("bucket").applyInPandas(_answer_strings, ANSWER)
    cut = here().cogroup(first.unionByName(second).groupBy("chunk")).applyInPandas(
        _cut(chunks, keep_text), "key string, first long, n_removed long, n_spans long, kept_sha256 string, kept string")
    copy = (F.col("ord") > F.col("first")) & (F.col("n_bytes") >= LENGTH)
    out = rows.drop("text").join(cut, "key").select(
        "doc", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(copy, F.lit(_EMPTY)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"))
    return out if keep_text else out.drop("kept")


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated passages cut out of the text, all rows and
    columns kept; a column n_chars counts the characters anew. A text that was
    nothing but a repeat is empty, a null one becomes empty."""
    found = passages(docs, id_col=id_col, text_col=text_col, keep_text=True)
    new = {text_col: F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


#: DuckDB SQL for the digests of `documents`.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n,
           coalesce(doc_id, {LAST}) AS o FROM documents),
s AS (SELECT r, o, unnest(range(0, n - {LENGTH - 1})) AS i,
      unnest(list_transform(range(0, n - {LENGTH - 1}), lambda i: b[i + 1:i + {LENGTH}])) AS s FROM d WHERE n >= {LENGTH}),
f AS (SELECT s, min(o) AS o FROM s GROUP BY s),
l AS (SELECT s.r, s.i FROM s JOIN f ON s.s = f.s WHERE f.o < s.o),
g AS (SELECT r, i, CASE WHEN i > lag(i) OVER w + {LENGTH} OR lag(i) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM l WINDOW w AS (PARTITION BY r ORDER BY i)),
u AS (SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS k FROM g),
x AS (SELECT r, k, min(i) AS a, max(i) + {LENGTH} AS e FROM u GROUP BY r, k),
t AS (SELECT r, sum(e - a) AS gone, count(*) AS spans FROM x GROUP BY r),
c AS (SELECT r, k, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY k) AS a, a AS e FROM x
      UNION ALL SELECT x.r, max(x.k) + 1, max(x.e), any_value(d.n) FROM x JOIN d ON x.r = d.r GROUP BY x.r),
k AS (SELECT c.r, string_agg(hex(d.b[c.a + 1:c.e]), '' ORDER BY c.k) AS h FROM c JOIN d ON c.r = d.r WHERE c.e > c.a GROUP BY c.r)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(t.gone, 0)::BIGINT AS n_removed, coalesce(t.spans, 0)::BIGINT AS n_spans,
       sha256(CASE WHEN t.r IS NULL THEN d.b ELSE unhex(coalesce(k.h, '')) END) AS kept_sha256
FROM d LEFT JOIN t ON d.r = t.r LEFT JOIN k ON d.r = k.r"""
