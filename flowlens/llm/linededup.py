"""Line de-duplication by a segment-partition edit join.

A line goes when an earlier line of the corpus (by doc_id, text hash, line number) is equal, or when both have at least
MIN_CHARS characters and are near: within EDITS edits, and one edit for each EDIT_CHARS characters of the shorter one (one at
least), so that short lines which differ in a number are not taken for copies.  Lines are told apart by a 128-bit hash.
For the rest, each distinct line has k + 1 disjoint
segments, where k is the number of edits allowed at its length and its length class gives their size: the first half of them
counted from its start, the others from its end.  Of two lines within k edits, some segment i of the shorter one stands in
the other with no edit in it, at most i before it and at most k - i after it (the first i with at most i edits up to its
end).  So each line looks up, named by (class, segment), the substrings at most that far from its own segments; a line whose
length is less than k above the end of the class before looks up those of that class, too.  That is 13 names for 4 edits,
2 for one.  Lines that share such a name are sorted by length, and those of near lengths compared by how often each kind of
character stands in them, which bounds their edit distance from below; the distance of the rest is followed along the
diagonals, from one edit to the next.

The names are 64-bit rolling hashes (a false one costs a check, never a result).  A task names equal lines once; the
names are dealt out once, and only those that two different lines share are kept.  A name shared by very many lines is
split into blocks; checked pairs are not collected, only the later line of each.  Tables that grow with the input are
joined by sort-merge whatever their size, so the plan is the same at every scale.

Defined cases: null and empty texts have no lines to drop and stay as they are; blank lines shorter than
MIN_CHARS are never dropped; rows
that share doc_id and text are one document and get one result; null doc_ids come last; a document that loses lines and
has none but blank ones left is dropped whole; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import bucket_blocks, runs, written
from flowlens.llm.textwords import mix

EDITS = 1
WORD_EDITS = 4  # of the registered query and the pipeline: covers the change of a short word or of a number
EDIT_CHARS = 12
MIN_CHARS = 20
BLOCK = 512
PIECE = 1 << 18  # characters hashed at a time
SEEN = 1 << 20  # lines that a task remembers as named
PROFILE = 32  # kinds of characters counted in a line; a power of two
VERIFIED = 1 << 13  # pairs whose distance is computed before the next ones are looked at
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOW = mix(np.arange(1, 0x3001, dtype=np.uint64) * np.uint64(_BASE))


# --- substring names ------------------------------------------------------------------


class Rolling:
    """Hashes of any substring of some lines."""

    def __init__(self, lines: list[str]):
        points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
        self.size = np.array([len(x) for x in lines], np.int64)
        self.at = np.cumsum(self.size) - self.size
        place = np.arange(len(points)) - np.repeat(self.at, self.size)
        most = int(self.size.max()) + 1 if len(lines) else 1
        power = np.full(most, _BASE, np.uint64)
        power[0] = 1
        self.back = np.full(most, _INVERSE, np.uint64)
        self.back[0] = 1
        power, self.back = np.multiply.accumulate(power), np.multiply.accumulate(self.back)
        value = _LOW[np.minimum(points, len(_LOW) - 1)]
        far = points >= len(_LOW)
        if far.any():
            value[far] = mix(points[far].astype(np.uint64) * np.uint64(_BASE))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power[place], dtype=np.uint64)])

    def hash(self, which: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        at = self.at[which] + start
        return (self.sums[at + size] - self.sums[at]) * self.back[start]


def classes(least: int, most: int, edits: int, chars: int | None = None) -> np.ndarray:
    """Least lengths of the length classes up to ``most`` and of the one after; each is at least edits + 1 wide.

    With ``chars`` (characters for each allowed edit), a class also ends where one edit more is allowed."""
    low, ends = [least], [chars * k for k in range(2, edits + 1)] if chars else []
    while low[-1] <= most:
        then, end = max(low[-1] + edits + 1, low[-1] * 5 // 4), next((x for x in ends if x > low[-1]), None)
        low.append(then if end is None or then + edits < end else end)
    return np.array(low, np.int64)


def names(lines: list[str], edits: int = EDITS, least: int = MIN_CHARS, chars: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, name, side): side 0 names the line's own segments, side 1 the substrings it looks up.

    Any two lines within ``edits`` share one; with ``chars``, two within one edit for each ``chars`` characters of the
    shorter one (one at least, ``edits`` at most), so that short lines have fewer and longer segments."""
    rolling = Rolling(lines)
    low = classes(least, int(rolling.size.max()) if lines else 0, edits, chars)
    most = allowed_edits(low, edits, chars) if chars else np.full(len(low), edits)
    whole = (rolling.size >= least).nonzero()[0]
    home = np.searchsorted(low, rolling.size[whole], "right") - 1
    which, place, first, back = [whole], [home], [np.zeros(len(whole), np.int8)], 1
    while True:  # lines that may be near one of the class before, of the one before that
        above = home >= back
        above[above] = rolling.size[whole[above]] < low[home[above] - back + 1] + most[home[above] - back]
        if not above.any():
            break
        which.append(whole[above])
        place.append(home[above] - back)
        first.append(np.ones(int(above.sum()), np.int8))
        back += 1
    which, place, first = np.concatenate(which), np.concatenate(place), np.concatenate(first)
    line, name, side = [], [], []
    for k in range(1, edits + 1):
        mine = (most[place] == k).nonzero()[0]
        if len(mine):
            _named(rolling, which[mine], low[place[mine]], first[mine], k, edits, line, name, side)
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((line, np.int64), (name, np.uint64), (side, np.int8)))


def _named(rolling: Rolling, which: np.ndarray, low: np.ndarray, first: np.ndarray, k: int, edits: int, line: list, name: list, side: list) -> None:
    """Adds the names of the lines ``which`` in classes of ``k`` allowed edits that begin at ``low``."""
    length, size = rolling.size[which], low // (k + 1)
    for i in range(k + 1):
        reach = min(i, k - i)
        home = i * size if 2 * i <= k else length - (k + 1 - i) * size
        tag = mix((low * (edits + 1) + i + 1).astype(np.uint64))
        for shift in range(-reach, reach + 1):
            at = home + shift
            ok = (at >= 0) & (at + size <= length)
            line.append(which[ok])
            name.append(mix(rolling.hash(which[ok], at[ok], size[ok]) + tag[ok]))
            side.append(np.ones(int(ok.sum()), np.int8) if shift else first[ok])


# --- edit distance ----------------------------------------------------------------------


def _same_from(a: str, i: int, b: str, j: int) -> int:
    """How many characters from a[i] on and from b[j] on are the same."""
    most, low, step = min(len(a) - i, len(b) - j), 0, 16
    while low < most:
        high = min(low + step, most)
        if a[i + low : i + high] != b[j + low : j + high]:
            break
        low, step = high, 4 * step
    else:
        return most
    while high - low > 1:
        middle = (low + high) // 2
        if a[i + low : i + middle] == b[j + low : j + middle]:
            low = middle
        else:
            high = middle
    return low


def _near(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``: the last row of a that each diagonal reaches, one edit after another,
    on the diagonals from which the last one can be reached with the edits left."""
    n, m = len(a), len(b)
    last = m - n
    if abs(last) > most:
        return False
    rows = [-most - 2] * (2 * most + 3)  # by diagonal (place in b less place in a) + most + 1
    for e in range(most + 1):
        reached = rows[:]
        for d in range(max(-e, last - most + e), min(e, last + most - e) + 1):
            k = d + most + 1
            i = min(max(rows[k] + 1, rows[k - 1], rows[k + 1] + 1), n, m - d) if e else 0
            reached[k] = i + _same_from(a, i, b, i + d) if i < n and i + d < m and a[i] == b[i + d] else i
        rows = reached
        if rows[last + most + 1] >= n:
            return True
    return False


def allowed_edits(shorter: np.ndarray, edits: int, chars: int = EDIT_CHARS) -> np.ndarray:
    """How many edits near lines may be apart, by the length of the shorter one."""
    return np.clip(shorter // chars, 1, edits)


def within_edits(a: list[str], b: list[str], edits: int, most: np.ndarray | None = None) -> np.ndarray:
    """Whether the edit distance of each pair (a[k], b[k]) is at most ``edits`` (and ``most[k]``, if given)."""
    most = np.full(len(a), edits) if most is None else np.minimum(most, edits)
    return np.fromiter(map(_near, a, b, most.tolist()), bool, len(a))


# --- the join ---------------------------------------------------------------------------


def _eligible(text: str | None, least: int, short: bool = False) -> tuple[list[int], list[str]]:
    """Places and lines of at least ``least`` characters; with ``short`` also the shorter ones that are not blank."""
    lines = (text or "").split("\n")
    places = [k for k, x in enumerate(lines) if len(x) >= least or short and x.strip()]
    return places, [lines[k] for k in places]


def _halves(line: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def _line_rows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, t, text in zip(*(batch.column(c) for c in ("doc_id", "th", "text"))):
                d, t = d.as_py(), t.as_py()
                for k, line in zip(*_eligible(text.as_py(), least, short=True)):
                    rows.append((d, t, k, *_halves(line)))
                if len(rows) > 20_000:
                    yield _long_rows(rows, ["doc_id", "th", "no", "h1", "h2"])
                    rows = []
            if rows:
                yield _long_rows(rows, ["doc_id", "th", "no", "h1", "h2"])

    return run


def _long_rows(rows: list[tuple], columns: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=columns)


def _name_rows(edits: int, least: int):
    def give(held: dict[int, str]) -> pa.RecordBatch:
        which, name, side = names(list(held.values()), edits, least, EDIT_CHARS)
        ident = np.array(list(held), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(ident[which]), pa.array(side.astype(np.int32))], names=["key", "id", "side"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            held, size = {}, 0
            for text in batch.column("text"):
                for line in _eligible(text.as_py(), least)[1]:
                    ident = _halves(line)[0]
                    if ident not in seen:
                        seen.add(ident)
                        held[ident] = line
                        size += len(line)
                if size > PIECE:
                    yield give(held)
                    held, size = {}, 0
                if len(seen) > SEEN:
                    seen.clear()
            if held:
                yield give(held)

    return run


def _wanted_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        idents, lines = [], []
        for text, wanted in zip(batch.column("text"), batch.column("wanted")):
            parts = text.as_py().split("\n")
            for w in wanted.as_py():
                idents.append((w["h1"], w["h2"]))
                lines.append(parts[w["no"]])
        halves = [pa.array(x, pa.int64()) for x in (zip(*idents) if idents else ((), ()))]
        yield pa.RecordBatch.from_arrays([*halves, pa.array(lines, pa.string())], names=["h1", "h2", "line"])


def _profiles(lines: list[str]) -> np.ndarray:
    """How often the characters of each of PROFILE kinds stand in a line (modulo 2^16)."""
    out, i = np.zeros((len(lines), PROFILE), np.int16), 0
    ends = np.cumsum([len(x) for x in lines])
    while i < len(lines):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PIECE, "right")))
        points = np.frombuffer("".join(lines[i:j]).encode("utf-32-le", "surrogatepass"), "<u4")
        kind = (points * np.uint32(0x9E3779B1)) >> np.uint32(32 - (PROFILE - 1).bit_length())
        row = np.repeat(np.arange(j - i), [len(x) for x in lines[i:j]])
        out[i:j] = np.bincount(row * PROFILE + kind, minlength=(j - i) * PROFILE).reshape(j - i, PROFILE).astype(np.int16)
        i = j
    return out


def _profile_edits(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A lower bound of the edit distance of lines with these profiles and differences in size: an edit puts at most one
    character in and takes at most one out."""
    return (np.abs(a - b).sum(1, dtype=np.int64) + np.abs(size)) // 2


def _near_sizes(group: np.ndarray, size: np.ndarray, most: np.ndarray, limit: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of a group, the shorter line before the longer, whose sizes differ by at most the shorter one's ``most``;
    about ``limit`` at a time."""
    rank = np.lexsort((size, group))
    at = group[rank] * (int(size.max()) + int(most.max()) + 1) + size[rank]
    later = np.searchsorted(at, at + most[rank], "right") - np.arange(1, len(at) + 1)
    total, i = np.concatenate([[0], np.cumsum(later)]), 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(total, total[i] + limit, "right")) - 1)
        x = np.repeat(np.arange(i, j), later[i:j])
        y = x + 1 + np.arange(len(x)) - np.repeat(total[i:j] - total[i], later[i:j])
        yield rank[x], rank[y]
        i = j


def _later_lines(edits: int):
    keys = ["key", "bi", "bj"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in runs(batches, keys):
            h1, h2, mine, side = (found.column(c).to_numpy() for c in ("h1", "h2", "mine", "side"))
            # lines by number within this run
            by_line = np.lexsort((h2, h1))
            new = np.zeros(len(h1), bool)
            new[1:] = (np.diff(h1[by_line]) != 0) | (np.diff(h2[by_line]) != 0)
            ident = np.empty(len(h1), np.int64)
            ident[by_line] = np.cumsum(new)
            first = np.unique(ident, return_index=True)[1]  # a row of each line
            # the lines' order in the corpus
            order = np.empty(len(first), np.int64)
            order[np.lexsort([found.column(c).to_numpy()[first] for c in ("no", "t", "d", "none")])] = np.arange(len(first))
            change = np.zeros(len(h1), np.int64)
            for c in keys:
                change[1:] |= np.diff(found.column(c).to_numpy()) != 0
            across = found.column("bi").to_numpy() != found.column("bj").to_numpy()
            lines = found.column("line").to_pylist()
            size = np.array([len(x) for x in lines])
            most = allowed_edits(size, edits)
            late = np.zeros(len(first), bool)  # by line number
            profiles, known = np.zeros((len(first), PROFILE), np.int16), np.zeros(len(first), bool)
            for x, y in _near_sizes(np.cumsum(change), size, most):
                a, b = ident[x], ident[y]
                last = np.where(order[a] < order[b], b, a)
                ok = (a != b) & ((side[x] == 0) | (side[y] == 0)) & (~across[x] | (mine[x] != mine[y])) & ~late[last]
                x, y, a, b, last = x[ok], y[ok], a[ok], b[ok], last[ok]
                unknown = np.zeros(len(first), bool)
                unknown[a] = unknown[b] = True
                unknown = (unknown & ~known).nonzero()[0]
                profiles[unknown] = _profiles([lines[i] for i in first[unknown]])
                known[unknown] = True
                ok = (_profile_edits(profiles[a], profiles[b], size[x] - size[y]) <= most[x]).nonzero()[0]
                for i in range(0, len(ok), VERIFIED):
                    part = ok[i : i + VERIFIED]
                    part = part[~late[last[part]]]
                    near = within_edits([lines[k] for k in x[part]], [lines[k] for k in y[part]], edits, most[x[part]])
                    late[last[part[near]]] = True
            if late.any():
                gone = first[late]
                yield pa.RecordBatch.from_arrays([pa.array(h1[gone]), pa.array(h2[gone])], names=["h1", "h2"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, lines, left = [], [], []
        for text, drop in zip(batch.column("text"), batch.column("drop")):
            text, drop = text.as_py(), set(drop.as_py() or ())
            parts = text.split("\n") if text is not None else []
            rest = [x for k, x in enumerate(parts) if k not in drop]
            lines.append(len(parts))
            texts.append("\n".join(rest) if drop else text)
            left.append(not drop or any(x.strip() for x in rest))
        kept = [batch.column(c) for c in batch.schema.names if c not in ("text", "drop")]
        columns = [*kept, pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(left, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=[*(c for c in batch.schema.names if c not in ("text", "drop")), "text", "n_lines", "kept"])


def near_later_lines(rows: DataFrame, firsts: DataFrame, edits: int, least: int) -> DataFrame:
    """(h1, h2) of the distinct lines that have an earlier, different line near them.

    Names go by half of a line's hash; the lines that meet are told apart by all of it."""

    named = rows.select("text").mapInArrow(_name_rows(edits, least), "key long, id long, side int")
    of = Window.partitionBy("key")
    shared = named.select("key", "id", "side", F.min("id").over(of).alias("a"), F.max("id").over(of).alias("b"), F.min("side").over(of).alias("s"))
    members = shared.where("a < b and s = 0").groupBy("key", "id").agg(F.min("side").alias("side"))
    members = written(members, "line-members")
    live = firsts.withColumn("id", F.col("h1")).join(members.select("id").distinct().hint("merge"), "id")
    live = written(live.select("id", "h1", "h2", "f.none", "f.d", "f.t", "f.no"), "line-places")
    wanted = live.groupBy("none", "d", "t").agg(F.collect_list(F.struct("h1", "h2", "no")).alias("wanted"))
    texts = rows.select(F.col("doc_id").isNull().cast("int").alias("none"), F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("th").alias("t"), "text")
    texts = texts.join(wanted.hint("merge"), ["none", "d", "t"]).select("text", "wanted").mapInArrow(_wanted_lines, "h1 long, h2 long, line string")
    texts = written(texts.dropDuplicates(["h1", "h2"]).join(live.hint("merge"), ["h1", "h2"]), "line-texts")
    blocks = bucket_blocks(members, "key", "id", BLOCK).join(texts.hint("merge"), "id")
    blocks = blocks.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    return blocks.mapInArrow(_later_lines(edits), "h1 long, h2 long").distinct()


def dedup_lines(docs: DataFrame, edits: int = EDITS, least: int = MIN_CHARS) -> DataFrame:
    """doc_id, text (without the dropped lines), n_lines, exact_dropped, near_dropped, kept and ``rest``, a struct of the
    other columns; one row per row of docs."""
    if least <= edits:
        raise ValueError("a line must have more characters than edits")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    lines = written(rows.mapInArrow(_line_rows(least), "doc_id long, th long, no long, h1 long, h2 long").distinct(), "lines")
    place = F.struct(F.col("doc_id").isNull().cast("int").alias("none"), F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("th").alias("t"), "no")
    firsts = written(lines.withColumn("f", place).groupBy("h1", "h2").agg(F.min("f").alias("f")), "first-lines")
    late = written(near_later_lines(rows, firsts, edits, least), "late-lines")
    known = firsts.join(late.withColumn("near", F.lit(True)).hint("merge"), ["h1", "h2"], "left")
    drops = lines.withColumn("p", place).join(known.hint("merge"), ["h1", "h2"])
    first = F.col("p") == F.col("f")
    near = F.coalesce("near", F.lit(False))
    drops = drops.where(~first | near).select(F.col("p.none").alias("none"), F.col("p.d").alias("d"), F.col("th"), "no", (~first).alias("again"))
    drops = drops.groupBy("none", "d", "th").agg(
        F.collect_list("no").alias("drop"), F.sum(F.col("again").cast("long")).alias("exact"), F.sum((~F.col("again")).cast("long")).alias("near")
    )
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    whole = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *others).alias("rest")
    )
    whole = whole.withColumn("th", F.xxhash64("text")).withColumn("none", F.col("doc_id").isNull().cast("int")).withColumn("d", F.coalesce("doc_id", F.lit(0)))
    whole = whole.join(drops.hint("merge"), ["none", "d", "th"], "left").select(
        "doc_id", "rest", F.coalesce("exact", F.lit(0)).alias("exact_dropped"), F.coalesce("near", F.lit(0)).alias("near_dropped"), "text", "drop"
    )
    out = T.StructType([f for f in whole.schema.fields if f.name not in ("text", "drop")])
    out = out.add("text", "string").add("n_lines", "long").add("kept", "boolean")
    return whole.mapInArrow(_cut, out)


def cleaned(docs: DataFrame, edits: int = EDITS, least: int = MIN_CHARS) -> DataFrame:
    """The documents that keep any text, with their columns; ``n_chars`` follows the text where it exists."""
    rows = dedup_lines(docs, edits, least).where("kept")
    given = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*[given.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])
