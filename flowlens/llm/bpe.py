"""Byte-level BPE by tree reduction: halves are encoded on their own and joined at the seam.

``encode`` of a piece splits it in halves down to short leaves and joins neighbours.  A join re-encodes a window of
tokens around the seam and widens it (doubling) until the tokens outside are proved to stay: that is, until the tokens
on both sides of each window edge, encoded together, come out as themselves.  Why this proves it: a merge across an
edge would have to win against the merges that form the two tokens beside it; those merges run in the same order in the
text of the two tokens alone, and there no merge across the edge won.  ``decode`` concatenates token bytes up a tree.

The text is first cut by the pretoken pattern; a piece that is itself a token is that token (as in the public rank-file
encoders).  Ranks are read on each executor from a path relative to an installed package, or from a file that the
caller distributes; they are never copied into this repository.

Defined cases: a null text counts as empty; an empty text has no tokens and the digest of no bytes; a text is encoded
whole, in one row, however long it is; repeated rows are encoded alike; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import lone_spaces, slices, utf8

RANKS = "byte_bpe_50k.tiktoken"
LEAF = 6
KNOWN = 1 << 20  # chunks a worker knows before it forgets them
CACHED = 1 << 19  # entries of each cache of a worker; a full cache is emptied, which costs time only
CACHED_CHARS = 64


#: A space between two characters that are no white space.
SAFE = re.compile(r"(?<=\S) (?=\S)")


def chunks(text: str) -> list[str]:
    """The text cut before every space between two characters that are no white space: there the pattern always starts a
    new match."""
    if lone_spaces(text):
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]
    at = [0, *(m.start() for m in SAFE.finditer(text)), len(text)]
    return [text[i:j] for i, j in zip(at, at[1:])]


def _room(cache: dict) -> dict:
    if len(cache) >= CACHED:
        cache.clear()
    return cache


class Bpe:
    """Encoder and decoder over a rank table {token bytes: rank}."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.base = len(ranks) + 1
        self.seams: dict[int, list[int] | None] = {}
        self.short: dict[bytes, list[int]] = {}
        self.pieces: dict[str, list[int]] = {}
        self._forget()

    # --- merging within a window

    def merge(self, data: bytes) -> list[int]:
        """Merge the lowest-ranked neighbours (leftmost first) until none is left."""
        n = len(data)
        if n > 64:
            return self._merge_heap(data)
        if n > 2 * LEAF:
            return self._merge_scan(data)
        known = self.short.get(data)
        if known is None:
            known = _room(self.short)[data] = self._merge_scan(data)
        return known

    def _merge_scan(self, data: bytes) -> list[int]:
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        none = len(ranks)
        pairs = [ranks.get(x + y, none) for x, y in zip(parts, parts[1:])]
        while pairs and (low := min(pairs)) < none:
            at = pairs.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1], none)
        return [ranks[p] for p in parts]

    def _merge_heap(self, data: bytes) -> list[int]:
        n, ranks = len(data), self.ranks
        end = list(range(1, n + 1))  # of the part that starts here; 0: no part starts here
        before = list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (r := ranks.get(data[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(n):
            offer(i)
        while heap:
            r, i, to = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != to:  # one of the two parts has changed
                continue
            end[i], end[j] = to, 0
            if to < n:
                before[to] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    # --- the monoid

    def seam(self, x: int, y: int) -> list[int] | None:
        """The encoding of tokens x and y together; None if it is x and y themselves, so that an edge between them stays."""
        key = x * self.base + y
        try:
            return self.seams[key]
        except KeyError:
            ids = self._merge_scan(self.tokens[x] + self.tokens[y])
            out = _room(self.seams)[key] = None if ids == [x, y] else ids
            return out

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of two texts together from the encodings of each."""
        if not a or not b:
            return a or b
        seam = self.seam
        window = self.seams.get(a[-1] * self.base + b[0], False)
        if window is False:
            window = seam(a[-1], b[0])
        if window is None:
            return a + b
        left = right = 1
        while True:
            lo, hi = max(0, len(a) - left), min(len(b), right)
            if left + right > 2:
                window = self.merge(b"".join([self.tokens[t] for t in a[lo:] + b[:hi]]))
            left_done = not lo or seam(a[lo - 1], window[0]) is None
            right_done = hi == len(b) or seam(window[-1], b[hi]) is None
            if left_done and right_done:
                return a[:lo] + window + b[hi:]
            left, right = left * (1 if left_done else 2), right * (1 if right_done else 2)

    def reduce(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.short.get(data) or self.merge(data)
        half = len(data) // 2
        return self.join(self.reduce(data[:half]), self.reduce(data[half:]))

    # --- texts

    def piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8")
        known = self.ranks.get(data)
        return [known] if known is not None else self.reduce(data)

    def _pieces(self, text: str) -> list[int]:
        known, out = self.pieces, []
        for p in self.pattern.findall(text):
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(p) <= CACHED_CHARS:
                    _room(known)[p] = ids
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and each text's place among them.  Each distinct chunk of the texts is encoded once."""
        if len(self.known) > KNOWN:
            self._forget()
        cut = [chunks(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(cut))
        number = list(map(self.known.get, flat))
        fresh = list({c for c, k in zip(flat, number) if k is None})
        if fresh:
            found = list(map(self._pieces, fresh))
            size = np.fromiter(map(len, found), np.int64, len(found))
            end = np.cumsum(size)
            base = len(self.known)
            self.known.update(zip(fresh, range(base, base + len(fresh))))
            self.begin, self.size = np.append(self.begin, len(self.flat) + end - size), np.append(self.size, size)
            self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(found), np.int32, int(end[-1])))
            number = [self.known[c] if k is None else k for c, k in zip(flat, number)]
        number = np.array(number, np.int64)
        size = self.size[number]
        end = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        ids = self.flat[np.repeat(self.begin[number] - end[:-1], size) + np.arange(end[-1])]
        return ids, end[np.cumsum([0, *map(len, cut)])]

    def decode(self, ids: list[int]) -> bytes:
        level = [b"".join(map(self.tokens.__getitem__, ids[i : i + 1024])) for i in range(0, len(ids), 1024)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


_LOADED: dict[str, Bpe] = {}


def load(ranks: str = RANKS) -> Bpe:
    """The encoder of a rank file of the installed tokenizer package, once for each Python worker."""
    import public_tokenizers

    if ranks not in _LOADED:
        _LOADED[ranks] = Bpe(read_ranks(public_tokenizers.path(ranks)), public_tokenizers.PATTERN)
    return _LOADED[ranks]


def _encoder(ranks: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            _, at = utf8(texts)
            for i, j in slices(at):
                flat, cut = bpe.encode_all([t or "" for t in texts.slice(i, j - i).to_pylist()])
                raw, listed, ends = memoryview(flat.astype("<u4").tobytes()), flat.tolist(), cut.tolist()
                sums = [hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(ends, ends[1:])]
                back = [hashlib.sha256(bpe.decode(listed[x:y])).hexdigest() for x, y in zip(ends, ends[1:])]
                columns = [ids.slice(i, j - i), pa.array(np.diff(cut), pa.int64()), pa.array(sums, pa.string()), pa.array(back, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns, names = [*columns, pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat, pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode_documents(docs: DataFrame, ranks: str = RANKS, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids themselves."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(_encoder(ranks, with_ids), schema + (", ids array<int>" if with_ids else ""))


def _decoder(ranks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                texts = [bpe.decode(x.as_py() or []) for x in batch.column("ids").slice(i, 256)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 256), pa.array(texts, pa.binary())], names=["doc_id", "bytes"])

    return run


def decode_documents(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id and the decoded bytes of rows with ``ids``."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(ranks), "doc_id long, bytes binary")
