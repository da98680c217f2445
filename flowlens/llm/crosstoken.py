"""Alignment of two tokenizers' tokens over whole texts, by an associative fragment monoid.

Both tokenizers cut the same bytes (a space and the text).  Where tokens of both end at one byte, a group closes.  A
fragment describes a byte range of a text by the tokens that end in it: an open prefix (up to the first common end), the
closed groups behind it and an open suffix (after the last common end).  Joining two neighbours closes one group out of
the left one's suffix and the right one's prefix; a range without a common end is all prefix.  The join is associative, so
fragments can be reduced in any tree.

* Texts below ``CHUNK`` bytes are aligned where they lie.  A space between two characters that are no white space starts
  a token of both kinds, so what lies between two such spaces (a chunk) is a fragment closed at both ends; a worker
  aligns each distinct chunk once and joins them by looking them up.
* Longer texts are cut, at such spaces, into segments that go to different tasks.  Each task tokenises its segments and
  cuts the tokens into fragments at every multiple of ``CHUNK`` bytes.  Rounds of a grouped join, ``FAN`` neighbours at a
  time, reduce each text's fragments to one.  (A text without such a space is one segment.)

How many documents hold a linked pair of ids, over the corpus: documents are packed into blocks, each with the list of its
distinct pairs and how many of its documents hold each.  The lists are summed by pair over all blocks, the best partner of
each first id is marked, and the sums go back to the blocks, where the documents' own sums are made.  So what is shuffled is
one row for each block and distinct pair, and each block once.

Defined cases: texts that are null or empty, or that the tokens' bytes do not spell (U+2581 in the text), have no tokens:
zeros, an empty group string.  Each row counts as a document, repeated rows and rows without doc_id included.  Columns
other than doc_id and text are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm import pieces
from flowlens.llm.common import lone_spaces, slices, utf8, written

BYTE_LEVEL = "byte_bpe_50k.json"
#: Texts of at least this many bytes are cut into segments of about this many for different tasks.
CHUNK = 1 << 16
#: Neighbouring fragments joined by one task of a round.
FAN = 16
#: A block of documents is closed at this many (document, distinct pair) entries.
BLOCK = 1 << 20
KNOWN_CHUNKS = 1 << 19

#: A space between two characters that are no white space.
SAFE = re.compile(r"(?<=\S) (?=\S)")


# --- the fragment monoid ----------------------------------------------------------------


def _no(kind) -> np.ndarray:
    return np.zeros(0, kind)


@dataclass
class Open:
    """Tokens of a group that is not closed on both sides: ids and end bytes of either kind."""

    a: np.ndarray = field(default_factory=lambda: _no(np.int32))
    a_end: np.ndarray = field(default_factory=lambda: _no(np.int64))
    b: np.ndarray = field(default_factory=lambda: _no(np.int32))
    b_end: np.ndarray = field(default_factory=lambda: _no(np.int64))

    def __add__(self, other: Open) -> Open:
        return Open(*(np.concatenate([getattr(self, k), getattr(other, k)]) for k in ("a", "a_end", "b", "b_end")))

    def cut(self, lo: int, hi: int) -> Open:
        """The tokens that end after byte lo and no later than hi."""
        x = slice(*np.searchsorted(self.a_end, [lo, hi], "right"))
        y = slice(*np.searchsorted(self.b_end, [lo, hi], "right"))
        return Open(self.a[x], self.a_end[x], self.b[y], self.b_end[y])


def both_ends(part: Open) -> tuple[np.ndarray, np.ndarray]:
    """The bytes where a token of either kind ends, and those where tokens of both do."""
    ends = np.sort(np.concatenate([part.a_end, part.b_end]), kind="stable")  # two sorted runs
    again = ends[1:] == ends[:-1]
    first = np.ones(len(ends), bool)
    first[1:] = ~again
    return ends[first], ends[1:][again]


def links(part: Open, ends: np.ndarray | None = None) -> np.ndarray:
    """The pair (A id << 32 | B id) of every two tokens whose bytes overlap, for tokens that cover the same bytes.

    Between two neighbouring ends (of either kind) lies exactly one overlap of one token of each kind."""
    ends = both_ends(part)[0] if ends is None else ends
    return part.a[np.searchsorted(part.a_end, ends)].astype(np.int64) << 32 | part.b[np.searchsorted(part.b_end, ends)]


def group_text(part: Open, common: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2,b3`` for the groups that end at ``common``."""
    out = []
    x = np.searchsorted(part.a_end, common, "right").tolist()
    y = np.searchsorted(part.b_end, common, "right").tolist()
    a, b = part.a.tolist(), part.b.tolist()
    i = j = 0
    for k, m in zip(x, y):
        out.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
        i, j = k, m
    return ";".join(out)


def add_up(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, sorted, and the sum of each one's times."""
    distinct, place = np.unique(pairs, return_inverse=True)
    return distinct, np.bincount(place, weights=times, minlength=len(distinct)).astype(np.int64)


@dataclass
class Fragment:
    cut: bool = False  # whether tokens of both kinds end together in the range
    prefix: Open = field(default_factory=Open)
    suffix: Open = field(default_factory=Open)
    n_a: int = 0  # of the closed groups, as the following
    n_b: int = 0
    n_groups: int = 0
    groups: str = ""
    pairs: np.ndarray = field(default_factory=lambda: _no(np.int64))
    times: np.ndarray = field(default_factory=lambda: _no(np.int64))

    @staticmethod
    def of(tokens: Open) -> Fragment:
        """The fragment of the tokens that end in a range."""
        common = both_ends(tokens)[1]
        if not len(common):
            return Fragment(prefix=tokens)
        first, last = int(common[0]), int(common[-1])
        far = max(int(tokens.a_end[-1]), int(tokens.b_end[-1]))
        closed = Fragment.closed(tokens.cut(first, last), common[1:])
        closed.prefix, closed.suffix = tokens.cut(-1, first), tokens.cut(last, far)
        return closed

    @staticmethod
    def closed(tokens: Open, common: np.ndarray) -> Fragment:
        """Whole groups that end at ``common``."""
        pairs, times = add_up(found := links(tokens), np.ones(len(found)))
        return Fragment(True, Open(), Open(), len(tokens.a), len(tokens.b), len(common), group_text(tokens, common), pairs, times)

    def _more(self, other: Fragment) -> Fragment:
        """The closed groups of both, ``self`` first."""
        pairs, times = add_up(np.concatenate([self.pairs, other.pairs]), np.concatenate([self.times, other.times]))
        text = ";".join(x for x in (self.groups, other.groups) if x)
        return Fragment(True, Open(), Open(), self.n_a + other.n_a, self.n_b + other.n_b, self.n_groups + other.n_groups, text, pairs, times)

    def __add__(self, other: Fragment) -> Fragment:
        if not self.cut and not other.cut:
            return Fragment(prefix=self.prefix + other.prefix)
        if not self.cut:
            both, prefix, suffix = other, self.prefix + other.prefix, other.suffix
        elif not other.cut:
            both, prefix, suffix = self, self.prefix, self.suffix + other.prefix
        else:
            seam = self.suffix + other.prefix
            both = self._more(Fragment.closed(seam, seam.a_end[-1:]))._more(other)
            prefix, suffix = self.prefix, other.suffix
        return Fragment(True, prefix, suffix, both.n_a, both.n_b, both.n_groups, both.groups, both.pairs, both.times)

    def whole(self) -> Fragment:
        """The fragment of a whole text: its prefix is the first group, and nothing stays open."""
        if not self.cut:
            return Fragment(True)
        return Fragment.closed(self.prefix, self.prefix.a_end[-1:])._more(self)


# --- both tokenizers over distinct chunks -----------------------------------------------


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    return {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}


def _safe_parts(text: str) -> list[str]:
    at = [0, *(m.start() for m in SAFE.finditer(text)), len(text)]
    return [text[i:j] for i, j in zip(at, at[1:])]


def _cuts(text: str) -> list[str]:
    """A space and the text, cut before every space between two characters that are no white space."""
    if lone_spaces(text):
        return [" " + x for x in text.split(" ")]
    return _safe_parts(" " + text)


class Tokenizers:
    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        letters = byte_letters()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else b""
        self.b = pieces.Pieces(b_path)
        self.b_bytes = self.b.surface
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        # each id's text and what follows it: a comma, or the end of its side of a group
        n, m = len(self.a_bytes), len(self.b_bytes)
        self.words = [f"{i}," for i in range(n)] + [f"{i}|" for i in range(n)] + [f"{i}," for i in range(m)] + [f"{i};" for i in range(m)]
        self._forget()

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of either kind and the place of each text among them; the texts begin with their space."""
        found = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        a_at = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        a = np.fromiter(chain.from_iterable(found), np.int32, int(a_at[-1]))
        b, b_at = self.b.encode_words([t.replace(" ", pieces.SPACE) for t in texts])
        return a, a_at, b, b_at

    def spelled(self, raw: list[bytes], ids: np.ndarray, at: np.ndarray, tokens: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Which texts the joined bytes of their tokens spell."""
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = ids.tolist()
        ends = np.append(0, np.cumsum(sizes[ids]))[at]
        if (np.diff(ends) == size).all() and b"".join(map(tokens.__getitem__, flat)) == b"".join(raw):
            return np.ones(len(raw), bool)
        return np.array([b"".join(map(tokens.__getitem__, flat[i:j])) == x for i, j, x in zip(at.tolist(), at[1:].tolist(), raw)], bool)

    # --- distinct chunks

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.sums = np.zeros((0, 4), np.int64)  # tokens A, tokens B, groups, whether the bytes spell the chunk
        self.begin, self.size, self.pairs = _no(np.int64), _no(np.int64), _no(np.int64)

    def learn(self, chunks: list[str]) -> None:
        """Align the chunks not known yet."""
        fresh = list(set(chunks) - self.known.keys())
        for i in range(0, len(fresh), pieces.TOGETHER):
            self._learn(fresh[i : i + pieces.TOGETHER])

    def _learn(self, chunks: list[str]) -> None:
        a, a_at, b, b_at = self.tokens(chunks)
        ok = self._spelled(chunks, a, a_at, b, b_at)
        if not ok.all():  # no tokens for these
            a_in, b_in = np.repeat(ok, np.diff(a_at)), np.repeat(ok, np.diff(b_at))
            a, b = a[a_in], b[b_in]
            a_at, b_at = (np.concatenate([np.zeros(1, np.int64), np.cumsum(np.where(ok, np.diff(x), 0))]) for x in (a_at, b_at))
        part = Open(a, np.cumsum(self.a_size[a]), b, np.cumsum(self.b_size[b]))
        ends, common = both_ends(part)
        a_group, b_group = np.searchsorted(common, part.a_end), np.searchsorted(common, part.b_end)
        x, y = np.searchsorted(part.a_end, common, "right"), np.searchsorted(part.b_end, common, "right")
        # tokens in the order of the text form: for each group its A tokens, then its B tokens
        n, m = len(self.a_bytes), len(self.b_bytes)
        order = np.zeros(len(a) + len(b), np.int64)
        a_ends, b_ends = np.zeros(len(a), bool), np.zeros(len(b), bool)
        a_ends[x - 1], b_ends[y - 1] = True, True
        order[np.arange(len(a)) + np.append(0, y)[a_group]] = a + n * a_ends
        order[np.arange(len(b)) + np.append(x, 0)[b_group]] = 2 * n + b + m * b_ends
        words = list(map(self.words.__getitem__, order.tolist()))
        cut = (a_at + b_at).tolist()
        base, held = len(self.known), len(self.pairs)
        self.known.update(zip(chunks, range(base, base + len(chunks))))
        self.texts += ["".join(words[i:j])[:-1] for i, j in zip(cut, cut[1:])]
        chunk_end = np.append(0, part.a_end)[a_at]
        groups = np.diff(np.searchsorted(common, chunk_end, "right"))
        self.sums = np.concatenate([self.sums, np.column_stack([np.diff(a_at), np.diff(b_at), groups, ok])])
        at = np.searchsorted(ends, chunk_end, "right")
        self.begin = np.append(self.begin, held + at[:-1])
        self.size = np.append(self.size, np.diff(at))
        self.pairs = np.append(self.pairs, links(part, ends))

    def align(self, texts: list[str]) -> dict[str, list | np.ndarray]:
        """Of each text: tokens, groups, links, the group text, and the distinct pairs with their times."""
        if len(self.known) > KNOWN_CHUNKS:
            self._forget()
        chunks = [_cuts(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(chunks))
        self.learn(flat)
        number = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))])
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.sums[number], axis=0)])
        sums = sums[at[1:]] - sums[at[:-1]]
        ok = sums[:, 3] == np.diff(at)
        sums[~ok] = 0
        cut, numbers, text = at.tolist(), number.tolist(), self.texts
        groups = [";".join([text[k] for k in numbers[i:j]]) if good else "" for i, j, good in zip(cut, cut[1:], ok.tolist())]
        # distinct chunks of each text, then distinct pairs
        row = np.repeat(np.arange(len(texts)), np.diff(at))
        base = len(self.known) + 1
        key, count = np.unique((row * base + number)[ok[row]], return_counts=True)
        row, number = key // base, key % base
        size = self.size[number]
        ends = np.cumsum(size)
        pairs = self.pairs[np.repeat(self.begin[number] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        row, pairs, times = _by_row(np.repeat(row, size), pairs, np.repeat(count, size), (len(self.a_bytes), len(self.b_bytes)))
        return {
            "n_a": sums[:, 0], "n_b": sums[:, 1], "n_groups": sums[:, 2], "n_links": sums[:, 0] + sums[:, 1] - sums[:, 2], "groups": groups,
            "at": np.searchsorted(row, np.arange(len(texts) + 1)), "pairs": pairs, "times": times,
        }

    def _spelled(self, texts: list[str], a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> np.ndarray:
        raw = [t.encode() for t in texts]
        return self.spelled(raw, a, a_at, self.a_bytes, self.a_size) & self.spelled(raw, b, b_at, self.b_bytes, self.b_size)

    def segment(self, text: str, start: int) -> Open | None:
        """The tokens of a text from byte ``start`` on; None if they do not spell it."""
        chunks = _safe_parts(text)
        number = {c: k for k, c in enumerate(dict.fromkeys(chunks))}
        distinct = list(number)
        a, a_at, b, b_at = self.tokens(distinct)
        if not self._spelled(distinct, a, a_at, b, b_at).all():
            return None
        order = np.fromiter(map(number.__getitem__, chunks), np.int64, len(chunks))
        a, b = _taken(a, a_at, order), _taken(b, b_at, order)
        return Open(a, start + np.cumsum(self.a_size[a]), b, start + np.cumsum(self.b_size[b]))


def _taken(flat: np.ndarray, at: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The parts ``flat[at[k]:at[k + 1]]`` for each k of ``order``."""
    size = np.diff(at)[order]
    ends = np.cumsum(size)
    return flat[np.repeat(at[order] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def _by_row(row: np.ndarray, pairs: np.ndarray, times: np.ndarray, ids: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, pair), sorted, and the sum of each one's times."""
    if not len(row):
        return _no(np.int64), _no(np.int64), _no(np.int64)
    low, high = int(ids[1] - 1).bit_length(), int(ids[0] - 1).bit_length() + int(ids[1] - 1).bit_length()
    few = int(times.max()).bit_length()
    if int(row.max()).bit_length() + high + few < 64:  # all of it in one number, which sorts quicker than places do
        key = np.sort(((row << high | (pairs >> 32) << low | (pairs & 0xFFFFFFFF)) << few) | times)
        key, times = key >> few, key & ((1 << few) - 1)
        row, pair = key >> high, key & ((1 << high) - 1)
        pairs = pair >> low << 32 | pair & ((1 << low) - 1)
    else:
        order = np.lexsort((pairs, row))
        row, pairs, times = row[order], pairs[order], times[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (pairs[1:] != pairs[:-1])
    at = first.nonzero()[0]
    return row[at], pairs[at], np.add.reduceat(times, at)


_LOADED: dict[tuple[str, str], Tokenizers] = {}


def load(a: str = BYTE_LEVEL, b: str = pieces.MODEL) -> Tokenizers:
    """Both tokenizers of the installed package, once for each Python worker."""
    import public_tokenizers

    if (a, b) not in _LOADED:
        _LOADED[a, b] = Tokenizers(public_tokenizers.path(a), public_tokenizers.path(b))
    return _LOADED[a, b]


# --- documents --------------------------------------------------------------------------

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"


def _aligner(a: str, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = load(a, b)
        for batch in batches:
            texts = batch.column("text")
            _, at = utf8(texts)
            for i, j in slices(at):
                x = both.align([t or "" for t in texts.slice(i, j - i).to_pylist()])
                cut = pa.array(x["at"], pa.int32())
                columns = [batch.column("doc_id").slice(i, j - i), *(pa.array(x[k], pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links"))]
                columns += [pa.array(x["groups"], pa.string()), *(pa.ListArray.from_arrays(cut, pa.array(x[k], pa.int64())) for k in ("pairs", "times"))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    return run


def _segments(chunk: int):
    """Cut a space and each text, at the first safe space after each multiple of ``chunk`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, ident, copies, text in zip(*(batch.column(k).to_pylist() for k in ("key", "doc_id", "copies", "text"))):
                text, at, start, number = " " + text, 0, 0, 0
                while at < len(text):
                    found = SAFE.search(text, min(at + chunk, len(text)))
                    end = found.start() if found else len(text)
                    part = text[at:end]
                    row = {"key": [key], "doc_id": pa.array([ident], pa.int64()), "copies": [copies], "number": [number], "start": [start], "segment": [part]}
                    yield pa.RecordBatch.from_pydict(row)
                    at, start, number = end, start + len(part.encode()), number + 1

    return run


_OPEN = [f"{side}_{k}" for side in ("prefix", "suffix") for k in ("a", "a_end", "b", "b_end")]
_CLOSED = ["n_a", "n_b", "n_groups", "groups", "pairs", "times"]
FRAGMENT = (
    "key string, doc_id long, copies long, place long, spelled boolean, cut boolean, "
    + ", ".join(f"{c} array<{'long' if c.endswith('end') else 'int'}>" for c in _OPEN)
    + ", n_a long, n_b long, n_groups long, groups string, pairs array<long>, times array<long>"
)


def _arrow_row(head: dict, x: Fragment) -> pa.Table:
    long, int_ = pa.int64(), pa.int32()
    row = {"key": pa.array([head["key"]], pa.string()), "doc_id": pa.array([head["doc_id"]], long), "copies": pa.array([head["copies"]], long)}
    row |= {"place": pa.array([head["place"]], long), "spelled": pa.array([head["spelled"]], pa.bool_()), "cut": pa.array([x.cut], pa.bool_())}
    for c in _OPEN:
        side, name = c.split("_", 1)
        row[c] = pa.array([getattr(getattr(x, side), name)], pa.list_(long if c.endswith("end") else int_))
    row |= {c: pa.array([getattr(x, c)], long) for c in ("n_a", "n_b", "n_groups")}
    row |= {"groups": pa.array([x.groups], pa.string()), **{c: pa.array([getattr(x, c)], pa.list_(long)) for c in ("pairs", "times")}}
    return pa.table(row)


def _fragment(rows: pa.Table, i: int) -> Fragment:
    def values(name: str) -> np.ndarray:
        return rows.column(name)[i].values.to_numpy()

    prefix, suffix = (Open(*(values(f"{side}_{k}") for k in ("a", "a_end", "b", "b_end"))) for side in ("prefix", "suffix"))
    counts = [rows.column(c)[i].as_py() for c in ("n_a", "n_b", "n_groups", "groups")]
    return Fragment(rows.column("cut")[i].as_py(), prefix, suffix, *counts, values("pairs"), values("times"))


def _fragments(a: str, b: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = load(a, b)
        for batch in batches:
            for x in batch.to_pylist():
                tokens = both.segment(x["segment"], x["start"])
                head = {k: x[k] for k in ("key", "doc_id", "copies")} | {"spelled": tokens is not None}
                first = x["start"] // chunk
                last = (x["start"] + len(x["segment"].encode()) - 1) // chunk
                for r in range(first, last + 1):
                    # neighbours differ in their range or their segment, so that places ascend
                    part = tokens.cut(r * chunk, (r + 1) * chunk) if tokens is not None else Open()
                    yield from _arrow_row(head | {"place": r + x["number"]}, Fragment.of(part)).to_batches()

    return run


def _reduce(fan: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        head = {k: rows.column(k)[0].as_py() for k in ("key", "doc_id", "copies", "place")}
        head |= {"place": head["place"] // fan, "spelled": all(rows.column("spelled").to_pylist())}
        level = [_fragment(rows, i) for i in range(rows.num_rows)] if head["spelled"] else [Fragment()]
        while len(level) > 1:
            level = [level[i] + level[i + 1] if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return _arrow_row(head, level[0])

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of ``ALIGNED`` of each whole text, as often as its row stood in the table."""
    kinds = {"groups": pa.string(), "pairs": pa.list_(pa.int64()), "times": pa.list_(pa.int64())}
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        for i in range(rows.num_rows):
            x = _fragment(rows, i).whole() if rows.column("spelled")[i].as_py() else Fragment(True)
            values = {"doc_id": rows.column("doc_id")[i].as_py(), "n_links": x.n_a + x.n_b - x.n_groups}
            names = [c.split()[0] for c in ALIGNED.split(", ")]
            columns = [pa.array([values[c] if c in values else getattr(x, c)], kinds.get(c, pa.int64())) for c in names]
            for _ in range(rows.column("copies")[i].as_py()):
                yield pa.RecordBatch.from_arrays(columns, names=names)


def _whole(docs: DataFrame, a: str, b: str, chunk: int) -> DataFrame:
    """Texts cut into segments over tasks, their fragments joined in rounds; one row for equal rows.

    The rows are stored: steps in Python that follow each other in one task hold a worker each, and any of an executor's
    workers may later be the one that loads the tokenizers."""
    spark = docs.sparkSession
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2("text", 256)), 256)
    once = docs.groupBy(key.alias("key")).agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    cut = once.mapInArrow(_segments(chunk), "key string, doc_id long, copies long, number long, start long, segment string")
    cut = cut.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "number")
    parts = written(cut.mapInArrow(_fragments(a, b, chunk), FRAGMENT), "fragments")
    top = parts.agg(F.max("place")).first()[0] or 0
    rounds = top > 0
    while top > 0:
        parts = parts.groupBy("key", F.floor(F.col("place") / FAN).alias("node")).applyInArrow(_reduce(FAN), FRAGMENT)
        top //= FAN
    return written(parts, "whole-fragments") if rounds else parts


def align_long(docs: DataFrame, a: str, b: str, chunk: int) -> DataFrame:
    """:func:`align_documents` of texts of any length.  Equal rows are done once and repeated."""
    return _whole(docs, a, b, chunk).mapInArrow(_finish, ALIGNED)


def align_documents(docs: DataFrame, a: str = BYTE_LEVEL, b: str = pieces.MODEL, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (text form), pairs (distinct A id << 32 | B id) and times (links of each)."""
    short, long = _by_length(docs, chunk)
    return short.mapInArrow(_aligner(a, b), ALIGNED).union(align_long(long, a, b, chunk))


def _by_length(docs: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    return rows.where(size < chunk), rows.where(size >= chunk)


# --- how many documents hold a pair -------------------------------------------------------


def _packer(names: list[str], block: int):
    """Put documents into blocks: their own columns, their pairs as places in the block's sorted distinct pairs."""

    def pack(parts: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        lists = rows.column("pairs").combine_chunks()
        count = np.diff(lists.offsets.to_numpy())
        pairs, place = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        times = rows.column("times").combine_chunks().flatten().to_numpy()
        step = place.copy()
        step[1:] -= place[:-1]
        raw = np.concatenate([x.astype("<i4") for x in (count, step, times)]).tobytes()
        columns = [pa.array([number], pa.int64()), pa.array([len(place)], pa.int64()), pa.array([pa.compress(raw, "zstd", asbytes=True)], pa.binary())]
        columns += [pa.array([pairs], pa.list_(pa.int64())), pa.array([np.bincount(place, minlength=len(pairs))], pa.list_(pa.int64()))]
        columns += [pa.array([rows.column(c).to_pylist()], pa.list_(rows.schema.field(c).type)) for c in names]
        return pa.RecordBatch.from_arrays(columns, names=["block", "entries", "places", "pairs", "holders", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                parts.append(batch.slice(i, 256))
                held += len(parts[-1].column("pairs").flatten()) + len(parts[-1])
                if held >= block:
                    yield pack(parts, number)
                    number, parts, held = number + 1, [], 0
        if parts:
            yield pack(parts, number)

    return run


def _sums(names: list[str]):
    def run(blocks: pa.Table, counts: pa.Table) -> pa.Table:
        rows = {c: blocks.column(c)[0].values for c in names}
        n, entries = len(rows[names[0]]), blocks.column("entries")[0].as_py()
        raw = np.frombuffer(pa.decompress(blocks.column("places")[0].as_py(), 4 * (n + 2 * entries), "zstd", asbytes=True), "<i4").astype(np.int64)
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(raw[:n])])
        place, times = np.cumsum(raw[n : n + entries]), raw[n + entries :]
        total, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, np.int64)
        total[counts.column("pos").to_numpy()] = counts.column("total").to_numpy()
        best[counts.column("pos").to_numpy()] = counts.column("best").to_numpy()
        for name, value in (("n_best", times * best[place]), ("count_sum", times * total[place])):
            sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(value)])
            rows[name] = pa.array(sums[at[1:]] - sums[at[:-1]], pa.int64())
        return pa.table(rows)

    return run


def _shown(shown: Callable[[str], str]):
    """Replace the group text by what is kept of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("groups")
            kept = pa.array(map(shown, batch.column(at).to_pylist()), pa.string())
            yield batch.set_column(at, "groups", kept)

    return run


def _in_turn(*steps):
    """The steps one after another in one worker, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        return batches

    return run


_OWN = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
_PACKED = "block long, entries long, places binary, pairs array<long>, holders array<long>, " + ", ".join(
    f"{c} array<{'string' if c == 'groups' else 'long'}>" for c in _OWN
)


def _counted(blocks: DataFrame) -> DataFrame:
    blocks = written(blocks, "blocks")
    held = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "holders")).alias("pos", "x")).select("block", "pos", "x.pairs", "x.holders")
    totals = held.groupBy("pairs").agg(F.sum("holders").alias("total"))
    # an A id has as many pairs as there are B ids at most, so that its window is bounded
    top = F.max("total").over(Window.partitionBy(F.shiftright("pairs", 32)))
    totals = totals.withColumn("best", (F.col("total") == top).cast("long"))
    counts = held.join(totals.hint("merge"), "pairs").select(F.col("block").alias("of_block"), "pos", "total", "best")
    result = ", ".join(f"{c} {'string' if c == 'groups' else 'long'}" for c in _OWN) + ", n_best long, count_sum long"
    return blocks.drop("pairs", "holders").groupBy("block").cogroup(counts.groupBy("of_block")).applyInArrow(_sums(_OWN), result)


def with_pair_counts(aligned: DataFrame, block: int = BLOCK) -> DataFrame:
    """The columns of ``aligned`` but its lists, and n_best and count_sum: links whose pair is held by most documents for
    its A id, and the sum over links of how many documents hold the pair."""
    return _counted(aligned.mapInArrow(_packer(_OWN, block), _PACKED))


def count_links(
    docs: DataFrame, shown: Callable[[str], str], a: str = BYTE_LEVEL, b: str = pieces.MODEL, chunk: int = CHUNK, block: int = BLOCK
) -> DataFrame:
    """:func:`with_pair_counts` of :func:`align_documents` in one worker for each task: the lists of pairs never leave it.

    ``shown`` says what is kept of a document's group text (a digest, say), in ``groups``."""
    short, long = _by_length(docs, chunk)
    packed = short.mapInArrow(_in_turn(_aligner(a, b), _shown(shown), _packer(_OWN, block)), _PACKED)
    whole = _whole(long, a, b, chunk)
    return _counted(packed.union(whole.mapInArrow(_in_turn(_finish, _shown(shown), _packer(_OWN, block)), _PACKED)))
