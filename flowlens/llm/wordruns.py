"""Periodic runs in the word sequences of whole texts, by a suffix automaton with link-cut access.

A run is a stretch of words with smallest period q, at least max(``LEAST``, 2q) words long, that no neighbouring word extends.

The automaton's suffix links form a tree.  Appending word i recolours the path from the state of the prefix that ends at i
to the root with colour i; the path falls into segments of one former colour.  In the segment coloured j, the deepest state's
length L is how far back the words before i and before j agree, and j is the last place where they do.  If i - j <= L, the
last L + (i - j) words have period i - j: they hold a square that ends at i, with no smaller period, and cannot be extended
to the left.  Comparing on to the right gives the run.  Every run is met at the end of its first square.

The access is done on the finished automaton's tree, whose paths to the root hold the same suffixes.  The preferred paths
of a link-cut tree are here kept as stacks of colour segments on the heavy paths of that tree: an access replaces the tops of
O(log n) stacks, and the segments it removes are those it made before, so the cost is O(n log n) amortised.

Most words are in no run, which a look at grams of six words shows: a run's words all lie in six-word grams that stand twice
within the run (for q >= 6 both halves of a square consist of them; for q < 6 the run's 12 words or more hold each gram q
words earlier or later as well).  Only stretches covered by grams that occur twice in the same stretch go through the automaton; cutting repeats
until nothing falls away.  That loses no run, and a run cannot reach over the end of its stretch.

Defined cases: a null or empty text has no words and no runs; words are ``[^\\x20\\x09-\\x0D]+``; a word is dropped if a run
holds it after the run's first q words; repeated rows are treated alike; rows without doc_id are kept; columns other than
doc_id and text are ignored.  A text is treated whole, in one row, however long; memory is in proportion to its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import slices, utf8
from flowlens.llm.textwords import mix

LEAST = 12
GRAM = LEAST // 2


# --- the automaton ----------------------------------------------------------------------


class SuffixAutomaton:
    """Lengths, suffix links and prefix states of a word sequence (words as numbers)."""

    def __init__(self, words: list[int]):
        length, link, after = [0], [-1], [{}]
        prefix, last = [], 0
        for n, c in enumerate(words, 1):
            state = len(length)
            length.append(n)
            link.append(0)
            after.append({})
            p = last
            while p >= 0 and c not in after[p]:
                after[p][c] = state
                p = link[p]
            if p >= 0:
                q = after[p][c]
                if length[q] != length[p] + 1:
                    copy = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    after.append(after[q].copy())
                    while p >= 0 and after[p].get(c) == q:
                        after[p][c] = copy
                        p = link[p]
                    link[q] = copy
                    q = copy
                link[state] = q
            last = state
            prefix.append(state)
        self.length, self.link, self.prefix = length, link, prefix

    def heavy_tops(self) -> list[int]:
        """The top of each state's heavy path; the root is a path of its own."""
        length, link = self.length, self.link
        order = np.argsort(np.array(length), kind="stable").tolist()  # parents before children
        size = [1] * len(length)
        for v in reversed(order[1:]):
            size[link[v]] += size[v]
        heavy = [0] * len(length)  # of each state, its child with the most states below
        most = [0] * len(length)
        for v in order[1:]:
            p = link[v]
            if size[v] > most[p]:
                most[p], heavy[p] = size[v], v
        top = list(range(len(length)))
        for v in order[1:]:
            p = link[v]
            if p and heavy[p] == v:
                top[v] = top[p]
        return top


def squares(words: list[int]) -> Iterator[tuple[int, int, int]]:
    """(i, d, L): the last L words up to word i stand d words earlier, too, with d <= L, nowhere later, and no more than L."""
    sam = SuffixAutomaton(words)
    length, link, top = sam.length, sam.link, sam.heavy_tops()
    # of each heavy path, its coloured segments from the deepest (first) to the top (last): longest length, colour
    deep: dict[int, list[int]] = {}
    colour: dict[int, list[int]] = {}
    for i, v in enumerate(sam.prefix):
        while v:  # up to the root, a heavy path at a time
            t, here = top[v], length[v]
            lengths, colours = deep.get(t), colour.get(t)
            if lengths is None:
                deep[t], colour[t] = [here], [i]
            else:
                long = 0
                while lengths and lengths[-1] <= here:
                    d = i - colours.pop()
                    long = lengths.pop()
                    if d <= long:
                        yield i, d, long
                if lengths and long < here and i - colours[-1] <= here:  # the upper part of a longer segment
                    yield i, i - colours[-1], here
                lengths.append(here)
                colours.append(i)
            v = link[t]


def runs_of(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    done: dict[int, int] = {}  # of each period, the end of the run found last
    found = []
    n = len(words)
    for i, d, long in squares(words.tolist()):
        if done.get(d, -1) >= i:
            continue
        start, end, step = i - long - d + 1, i + 1, 64
        while end < n:
            to = min(n, end + step)
            differ = (words[end:to] != words[end - d : to - d]).nonzero()[0]
            if len(differ):
                end += int(differ[0])
                break
            end, step = to, step * 2
        done[d] = end - 1
        if end - start >= max(least, 2 * d):
            found.append((start, end - start, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


# --- where runs can be ------------------------------------------------------------------


def stretches(words: np.ndarray, row: np.ndarray) -> np.ndarray:
    """(begin, end) of the stretches that may hold runs; ``words`` of many rows, ``row`` the row of each."""
    at, owner = np.arange(len(words)), row.astype(np.int64)
    while len(at) >= LEAST:
        n = len(at) - GRAM + 1
        gram = np.zeros(n, np.uint64)
        for k in range(GRAM):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + mix(words[at[k : n + k]].astype(np.uint64) + np.uint64(1))
        whole = (owner[:n] == owner[GRAM - 1 :]) & (at[GRAM - 1 :] - at[:n] == GRAM - 1)
        gram = mix(gram + mix(owner[:n].astype(np.uint64) + np.uint64(7)))
        order = np.argsort(gram, kind="stable")
        order = order[whole[order]]
        same = gram[order[1:]] == gram[order[:-1]]
        twice = np.zeros(n, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        # the words that such a gram covers
        cover = np.zeros(len(at) + 1, np.int64)
        hits = twice.nonzero()[0]
        cover[hits] += 1
        cover[hits + GRAM] -= 1
        held = np.cumsum(cover[:-1]) > 0
        if held.all():
            break
        # neighbours stay one stretch only where their words are neighbours
        kept = held.nonzero()[0]
        new = np.ones(len(kept), bool)
        new[1:] = (np.diff(at[kept]) != 1) | (np.diff(owner[kept]) != 0)
        at, stretch = at[kept], np.cumsum(new) - 1
        size = np.bincount(stretch)
        long = size[stretch] >= LEAST
        at, owner = at[long], stretch[long]
    if len(at) < LEAST:
        return np.zeros((0, 2), np.int64)
    first = np.ones(len(at), bool)
    first[1:] = np.diff(owner) != 0
    begin = at[first.nonzero()[0]]
    end = at[np.append(first.nonzero()[0][1:], len(at)) - 1] + 1
    return np.column_stack([begin, end])


def find_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each word list: (start, length, period) by start, then period."""
    flat = [w for words in texts for w in words]
    number = {w: k for k, w in enumerate(dict.fromkeys(flat))}
    words = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    cut = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=cut[1:])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    places = stretches(words, np.repeat(np.arange(len(texts)), np.diff(cut)))
    rows = np.searchsorted(cut, places[:, 0], "right") - 1
    for row, (begin, end) in zip(rows.tolist(), places.tolist()):
        _, small = np.unique(words[begin:end], return_inverse=True)
        shift = begin - int(cut[row])
        out[row] += [(s + shift, n, d) for s, n, d in runs_of(small)]
    return out


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [words[k] for k in (np.cumsum(gone[:-1]) == 0).nonzero()[0].tolist()]


# --- documents --------------------------------------------------------------------------

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def _finder(rewrite: Rewrite | None):
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            _, at = utf8(texts)
            for i, j in slices(at):
                # bytes.split cuts at just the six white-space bytes
                words = [(t or "").encode().split() for t in texts.slice(i, j - i).to_pylist()]
                if rewrite is not None:
                    words = [rewrite(k, w) for k, w in zip(ids.slice(i, j - i).to_pylist(), words)]
                runs = find_runs(words)
                flat = np.array([r for x in runs for r in x], np.int64).reshape(-1, 3)
                cut = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) for x in runs])])
                rows = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(run_type))
                text = pa.array([b" ".join(kept_words(w, r)) for w, r in zip(words, runs)], pa.binary()).cast(pa.string())
                columns = [ids.slice(i, j - i), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), rows), text]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, runs (start, length, period by start, then period) and the collapsed text (kept words joined by a space).

    ``rewrite`` may change a document's words (doc_id, words) before the search."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_finder(rewrite), "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
