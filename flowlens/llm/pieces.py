"""SentencePiece BPE by vectorised merge rounds, and its decoding.

A text is normalised as the model says (a space in front, spaces as U+2581), then cut into words: a run of spaces with the
run of other characters behind it.  The distinct words of a slice of texts are encoded together.  Their characters lie in
one flat symbol array, cut into segments wherever two neighbouring characters stand side by side in no piece of the
vocabulary, since no merge can ever join them.  A round finds every neighbour pair's rank, the least rank of each segment
(``minimum.reduceat``), merges all of the segment's pairs of that rank from left to right at once, and moves finished
segments out, until no pair remains.

Merging all pairs of one rank at once equals merging them one by one, leftmost first, unless a merge makes a new pair that
ranks no later than the pair just merged.  Every round looks up the new pairs; a segment where that happens (runs of
spaces, whose pieces share one score) is finished by the one-by-one order, with a heap.

Characters that no merge took in and that are no pieces become their UTF-8 bytes' pieces.  The vocabulary is read on each
executor from an installed package's model file; it is never copied into this repository.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to the empty text; a text is encoded whole,
however long; repeated rows are encoded alike; columns other than doc_id and text are ignored.  Models other than BPE with
byte fallback and the identity normaliser, or with user-defined or unused pieces, are refused.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import slices, utf8

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
NONE = np.int32(2**31 - 1)
#: A worker forgets the words it knows beyond these many words or characters; that costs time only.
KNOWN_WORDS = 1 << 19
KNOWN_CHARS = 1 << 24
#: Distinct words that are encoded together.
TOGETHER = 1 << 15


# --- the model file -------------------------------------------------------------------


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        x = data[i]
        i, value, shift = i + 1, value | (x & 127) << shift, shift + 7
        if x < 128:
            return value, i


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message's fields."""
    i = 0
    while i < len(data):
        key, i = _varint(data, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(data, i)
        else:
            if kind == 2:
                size, i = _varint(data, i)
            else:
                size = 8 if kind == 1 else 4
            value, i = data[i : i + size], i + size
        yield key >> 3, value


def read_model(path: str) -> tuple[list[tuple[str, float, int]], dict, dict]:
    """Pieces (text, score, type), trainer and normaliser settings by field number."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, trainer, normaliser = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            x = dict(_fields(value))
            pieces.append((x[1].decode("utf-8"), struct.unpack("<f", x.get(2, b"\0\0\0\0"))[0], x.get(3, 1)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normaliser = dict(_fields(value))
    return pieces, trainer, normaliser


#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


# --- a sorted map from pairs to merges --------------------------------------------------


class PairTable:
    """(left, right) symbols to (merged symbol, rank) by open addressing in NumPy arrays."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], base: int):
        self.base = np.int64(base)
        bits = max(4, int(len(pairs) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.key = np.full(1 << bits, -1, np.int64)
        self.at = np.zeros(1 << bits, np.int32)
        keys = np.array([x * base + y for x, y in pairs], np.int64)
        place = self._place(keys)
        left = np.arange(len(keys))
        while len(left):
            p = place[left]
            free = self.key[p] < 0
            self.key[p[free]] = keys[left[free]]
            held = self.key[p] == keys[left]
            self.at[p[held]] = left[held]
            left = left[~held]
            place[left] = (place[left] + 1) & self.mask
        values = np.array(list(pairs.values()), np.int32).reshape(-1, 2)
        self.merged, self.rank = np.append(values[:, 0], 0).astype(np.int32), np.append(values[:, 1], NONE)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Entry numbers into ``merged`` and ``rank``; the last entry (rank NONE) for what is no pair."""
        keys = left.astype(np.int64) * self.base + right
        out = np.full(len(keys), len(self.rank) - 1, np.int32)
        place, todo = self._place(keys), np.arange(len(keys))
        while len(todo):
            held = self.key[place]
            same = held == keys[todo]
            out[todo[same]] = self.at[place[same]]
            on = ~same & (held >= 0)
            todo, place = todo[on], (place[on] + 1) & self.mask
        return out


# --- the encoder ----------------------------------------------------------------------


class Pieces:
    def __init__(self, path: str):
        pieces, trainer, normaliser = read_model(path)
        plain = (
            trainer.get(3) == 2 and trainer.get(35) == 1 and not trainer.get(24) and normaliser.get(1) == b"identity" and not normaliser.get(2)
            and normaliser.get(3, 1) == 1 and normaliser.get(4, 1) == 0 and normaliser.get(5, 1) == 1
            and {t for _, _, t in pieces} <= {NORMAL, UNKNOWN, CONTROL, BYTE}
        )
        if not plain:
            raise ValueError(f"{path}: only BPE models with byte fallback and the identity normaliser are supported")
        self.n = len(pieces)
        self.byte_id = np.zeros(256, np.int32)
        normal = {}
        self.surface: list[bytes] = []
        self.byte_of: dict[int, int] = {}
        self.unknown, self.silent = -1, set()
        for i, (text, _, kind) in enumerate(pieces):
            # a control piece writes nothing but ends a run of bytes: a byte that is in no UTF-8 leads to the careful way
            self.surface.append(text.replace(SPACE, " ").encode() if kind == NORMAL else b"\xff")
            if kind == NORMAL:
                normal[text] = i
            elif kind == BYTE:
                value = int(text[1:-1], 16)
                self.byte_id[value], self.byte_of[i], self.surface[i] = i, value, bytes([value])
            elif kind == CONTROL:
                self.silent.add(i)
            elif kind == UNKNOWN:
                self.unknown, self.surface[i] = i, trainer.get(44, b" \xe2\x81\x87 ")
        scores = sorted({pieces[i][1] for i in normal.values()}, reverse=True)
        rank = {s: k for k, s in enumerate(scores)}
        symbols = dict(normal)
        for text in normal:
            for c in text:
                symbols.setdefault(c, self.n + len(symbols))  # a character that only stands inside pieces
        self.other = max(self.n, *symbols.values()) + 1  # any other character
        self.symbol = np.full(0x110000, self.other, np.int32)
        for text, i in symbols.items():
            if len(text) == 1:
                self.symbol[ord(text)] = i
        pairs, beside = {}, {}
        for text, i in normal.items():
            for k in range(1, len(text)):
                x, y = symbols.get(text[:k]), symbols.get(text[k:])
                if x is not None and y is not None:
                    pairs[x, y] = (i, rank[pieces[i][1]])
                beside[symbols[text[k - 1]], symbols[text[k]]] = (0, 0)
        self.pairs, self.pair_map = PairTable(pairs, self.other + 1), pairs
        self.beside = PairTable(beside, self.other + 1)
        # a line break that no piece joins to another character is a word of its own: shorter, more often repeated words
        joined = {c for text in normal if len(text) > 1 for c in text}
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in joined)
        after_space = any(a != SPACE and b == SPACE for text in normal for a, b in zip(text, text[1:]))
        if after_space:
            raise ValueError(f"{path}: pieces that hold a space after another character are not supported")
        s = SPACE
        self.word = re.compile((f"[{alone}]|" if alone else "") + f"{s}*[^{s}{alone}]+|{s}+")
        self._forget()

    # --- distinct words

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and each word's place among them (one more at the end)."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        begin = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, len(words)), out=begin[1:])
        if not len(chars):
            return np.zeros(0, np.int32), begin
        sym = self.symbol[chars]
        cut = np.ones(len(sym), bool)
        cut[1:] = self.beside.find(sym[:-1], sym[1:]) == len(self.beside.rank) - 1
        cut[begin[:-1][begin[:-1] < len(sym)]] = True
        at, sym = self._rounds(sym, cut.nonzero()[0])
        first = np.searchsorted(at, begin)
        # characters without a piece: their bytes
        raw = sym >= self.n
        if raw.any():
            lost = chars[at[raw]]
            size = 1 + (lost >= 0x80).astype(np.int64) + (lost >= 0x800) + (lost >= 0x10000)
            width = np.ones(len(sym), np.int64)
            width[raw] = size
            bytes_ = np.frombuffer(lost.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
            sym = np.repeat(sym, width)
            sym[np.repeat(raw, width)] = self.byte_id[bytes_]
            first = np.concatenate([np.zeros(1, np.int64), np.cumsum(width)])[first]
        return sym.astype(np.int32), first

    def _rounds(self, sym: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge within the segments that begin at ``starts``: (first character, symbol) of what is left, in order."""
        table = self.pairs
        none = len(table.rank) - 1
        at = np.arange(len(sym))
        count = np.diff(np.append(starts, len(sym)))
        pair = np.full(len(sym), none, np.int32)  # the entry of (this symbol, the next); none at a segment's end
        last = np.zeros(len(sym), bool)
        last[np.append(starts[1:], len(sym)) - 1] = True
        inner = (~last).nonzero()[0]
        pair[inner] = table.find(sym[inner], sym[inner + 1])
        done_at, done_sym = [], []
        while len(sym):
            rank = table.rank[pair]
            low = np.minimum.reduceat(rank, starts)
            live = low < NONE
            if not live.all():  # finished segments move out
                stay = np.repeat(live, count)
                done_at.append(at[~stay])
                done_sym.append(sym[~stay])
                sym, at, pair, rank, last = sym[stay], at[stay], pair[stay], rank[stay], last[stay]
                low, count = low[live], count[live]
                if not len(sym):
                    break
                starts = np.cumsum(count) - count
            segment = np.repeat(np.arange(len(count)), count)
            hit = (rank == low[segment]).nonzero()[0]
            # of overlapping pairs every second one, from the left
            run = np.ones(len(hit), bool)
            run[1:] = np.diff(hit) != 1
            nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[nth % 2 == 0]
            merged = table.merged[pair[hit]]
            # the new pairs to the left (the symbol there may have merged, too) and to the right
            whole = sym.copy()
            whole[hit] = merged
            gone = np.zeros(len(sym), bool)
            gone[hit + 1] = True
            left = hit - 1
            left[(left >= 0) & gone[left]] -= 1
            has_left = (hit > 0) & ~last[hit - 1]
            new_left = np.full(len(hit), none, np.int32)
            new_left[has_left] = table.find(whole[left[has_left]], merged[has_left])
            has_right = ~last[hit + 1]
            new_right = np.full(len(hit), none, np.int32)
            new_right[has_right] = table.find(merged[has_right], sym[hit[has_right] + 2])
            owner = segment[hit]
            many = np.bincount(owner, minlength=len(count))[owner] > 1
            early = many & (np.minimum(table.rank[new_left], table.rank[new_right]) <= low[owner])
            if early.any():  # one by one
                slow = np.zeros(len(count), bool)
                slow[owner[early]] = True
                for k in slow.nonzero()[0].tolist():
                    x, y = int(starts[k]), int(starts[k] + count[k])
                    places, symbols = self._one_by_one(sym[x:y].tolist())
                    done_at.append(at[x:y][places])
                    done_sym.append(np.array(symbols, np.int32))
                out = slow[segment]
                fast = ~slow[owner]
                hit, whole[out] = hit[fast], sym[out]
                merged, new_left, has_left, left = merged[fast], new_left[fast], has_left[fast], left[fast]
                gone = out.copy()
                gone[hit + 1] = True
                count = np.where(slow, 0, count)
            last[hit] = last[hit + 1]
            last_pair = np.full(len(hit), none, np.int32)
            right = hit + 2
            inside = ~last[hit]
            last_pair[inside] = table.find(whole[hit[inside]], whole[right[inside]])
            pair[left[has_left]] = new_left[has_left]
            pair[hit] = last_pair
            count = count - np.bincount(segment[hit], minlength=len(count))
            stay = ~gone
            sym, at, pair, last = whole[stay], at[stay], pair[stay], last[stay]
            count = count[count > 0]
            starts = np.cumsum(count) - count
        at, sym = np.concatenate(done_at), np.concatenate(done_sym)
        order = np.argsort(at, kind="stable")
        return at[order], sym[order]

    def _one_by_one(self, sym: list[int]) -> tuple[list[int], list[int]]:
        """Merge the best pair, leftmost first, one at a time: places and symbols of what is left."""
        n, pairs = len(sym), self.pair_map
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (found := pairs.get((sym[i], sym[after[i]]))):
                heapq.heappush(heap, (found[1], i, sym[i], sym[after[i]]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if sym[i] != x or j >= n or sym[j] != y:
                continue
            sym[i], sym[j] = pairs[x, y][0], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        places = [i for i in range(n) if sym[i] >= 0]
        return places, [sym[i] for i in places]

    # --- texts

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, words: list[str]) -> None:
        """Encode the words not known yet."""
        fresh = list(set(words) - self.known.keys())
        for i in range(0, len(fresh), TOGETHER):
            part = fresh[i : i + TOGETHER]
            ids, first = self.encode_words(part)
            base = len(self.known)
            self.known.update(zip(part, range(base, base + len(part))))
            self.begin = np.append(self.begin, first[:-1] + len(self.flat))
            self.size = np.append(self.size, np.diff(first))
            self.flat = np.append(self.flat, ids)
        self.chars += sum(map(len, fresh))

    def encode(self, texts: list[str], prefix: str = " ") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and each text's place among them; ``prefix`` stands before a text that is not empty."""
        if len(self.known) > KNOWN_WORDS or self.chars > KNOWN_CHARS:
            self._forget()
        words, counts = [], []
        for t in texts:
            found = self.word.findall((prefix + t).replace(" ", SPACE)) if t else []
            words += found
            counts.append(len(found))
        self.learn(words)
        number = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        size = self.size[number]
        end = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        ids = self.flat[np.repeat(self.begin[number] - end[:-1], size) + np.arange(end[-1])]
        return ids, end[np.concatenate([np.zeros(1, np.int64), np.cumsum(np.array(counts, np.int64))])]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: the space in front goes, and bytes that are no UTF-8 become U+FFFD each."""
        try:
            text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8")
        except UnicodeDecodeError:
            text = "".join(self._runs(ids))
        if not text.startswith(" "):
            return text
        # the space goes if the first piece that writes anything begins with it; a byte 0x20 or the unknown mark stay
        first = next(i for i in ids if i not in self.silent)
        return text if first in self.byte_of or first == self.unknown else text[1:]

    def _runs(self, ids: list[int]) -> Iterator[str]:
        i = 0
        while i < len(ids):
            run = bytearray()
            while i < len(ids) and ids[i] in self.byte_of:
                run.append(self.byte_of[ids[i]])
                i += 1
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        yield run[at : at + size].decode("utf-8")
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    yield "�"
                    at += 1
            if i < len(ids):
                yield "" if ids[i] in self.silent else self.surface[ids[i]].decode("utf-8")
                i += 1


_LOADED: dict[str, Pieces] = {}


def load(model: str = MODEL) -> Pieces:
    """The encoder of a model file of the installed tokenizer package, once for each Python worker."""
    import public_tokenizers

    if model not in _LOADED:
        _LOADED[model] = Pieces(public_tokenizers.path(model))
    return _LOADED[model]


def _encoder(model: str, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            texts = batch.column("text")
            _, at = utf8(texts)
            for i, j in slices(at):
                ids, end = pieces.encode([t or "" for t in texts.slice(i, j - i).to_pylist()])
                columns = [batch.column("doc_id").slice(i, j - i), pa.ListArray.from_arrays(pa.array(end, pa.int32()), pa.array(ids, pa.int32()))]
                names = ["doc_id", "ids"]
                if with_text:
                    flat, cuts = ids.tolist(), end.tolist()
                    columns.append(pa.array([pieces.decode(flat[x:y]) for x, y in zip(cuts, cuts[1:])], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode_documents(docs: DataFrame, model: str = MODEL, with_text: bool = False) -> DataFrame:
    """doc_id, ids and, if asked for, the text decoded from the ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encoder(model, with_text), "doc_id long, ids array<int>" + (", decoded string" if with_text else ""))


def _decoder(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                texts = [pieces.decode(x or []) for x in batch.column("ids").slice(i, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 256), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return run


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and the decoded text of rows with ``ids`` (null: none)."""
    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decoder(model), "doc_id long, decoded string")
