"""Each operator against a brute-force version on small rows: nulls, empty and long texts, ties, repeated rows, empty
tables and extra columns whose names clash with internal ones."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib
from operator import mul

import numpy as np
import pytest

from flowlens.llm import bpe, common, crf, linededup, minhash, mixing, pivots, pstable, pulearn, sharding, warc
from flowlens.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, `_kept` string, score double"


def words(n, seed):
    r = random.Random(seed)
    return [r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho".split()) + str(r.randrange(40)) for _ in range(n)]


def make_rows():
    base, rows = words(120, 1), []
    for i in range(30):
        t = base[:]
        for k in random.Random(i).sample(range(120), i % 4):
            t[k] = f"edit{i}x{k}"
        rows.append((i, "\n".join(" ".join(t[j : j + 12]) for j in range(0, 120, 12))))
    rows += [(100 + i, " ".join(words(30 + i, 50 + i))) for i in range(30)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "one two"), (204, "One  two"), (205, " ".join(words(20_000, 9)))]
    rows += [(None, rows[0][1]), (5, rows[5][1]), (5, rows[5][1]), (None, None)]
    return [(d, t, "en", f"s{(d or 0) % 3}" if d != 7 else None, len(t or ""), 1, "x", 0.5) for d, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make_rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 440)] + [(3, 3)]
    want = components(pairs, {x for p in pairs for x in p})
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    alone = {n for n in want if all(n not in p or p[0] == p[1] for p in pairs)}
    assert got == {n: c for n, c in want.items() if n not in alone}


def test_minhash(docs, empty):
    got = minhash.near_duplicates(docs).collect()
    sets = {(r[0], r[1]): shingles(r[1]) for r in make_rows()}
    near = lambda x, y: x and y and 100 * len(x & y) >= 75 * len(x | y)
    named = {d: s for (d, _), s in sets.items() if d is not None}
    want = components([(a, b) for a, b in itertools.combinations(sorted(named), 2) if near(named[a], named[b])], named)
    assert len(got) == len(make_rows())
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(named[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
        else:
            assert (r.n_shingles, r.component_id) in ((0, None), (len(named[0]), want[0]))
    assert minhash.near_duplicates(empty).collect() == []


def test_minhash_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rows, base = [], words(60, 4)
    for i in range(80):
        t = base[:]
        for k in random.Random(i).sample(range(60), 2 + i % 3):
            t[k] = f"v{i}k{k}"
        rows.append((i, " ".join(t)))
    sets = {d: shingles(t) for d, t in rows}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(pairs, sets)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j: min(left + 1, row[j] + 1, row[j - 1] + (x != b[j - 1])), initial=i))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 4])
def test_edit_distance_and_names(edits):
    r = random.Random(edits)
    a, b = [], []
    for _ in range(400):
        s = "".join(r.choice("abcé😀") for _ in range(r.randrange(20, 45)))
        t = list(s)
        for _ in range(r.randrange(edits + 3)):
            k = r.randrange(len(t))
            t[k : k + r.choice([0, 1])] = r.choice(["", "x", "y"])
        a.append(s)
        b.append("".join(t))
    want = np.array([distance(x, y) <= edits for x, y in zip(a, b)])
    assert (linededup.within_edits(a, b, edits) == want).all()
    for x, y, near in zip(a, b, want):
        if near and x != y and min(len(x), len(y)) >= 20:
            line, name, side = linededup.names([x, y], edits, 20)
            own = lambda k, s: set(name[(line == k) & (side <= s)].tolist())
            assert own(0, 0) & own(1, 1) or own(1, 0) & own(0, 1)


def test_names_by_allowed_edits():
    """Lines within the edits that the shorter one's length allows share a name, at every length around the classes' ends;
    a short line has few names."""
    r = random.Random(3)
    for size in list(range(20, 66)) * 12:
        x = "".join(r.choice("abcé😀") for _ in range(size))
        t = list(x)
        for _ in range(r.randrange(1, 6)):
            k = r.randrange(len(t))
            t[k : k + r.choice([0, 1])] = r.choice(["", "x", "y"])
        y = "".join(t)
        if x != y and len(y) >= 20 and distance(x, y) <= linededup.allowed_edits(np.array(min(len(x), len(y))), 4):
            line, name, side = linededup.names([x, y], 4, 20, linededup.EDIT_CHARS)
            own = lambda k, s: set(name[(line == k) & (side <= s)].tolist())
            assert own(0, 0) & own(1, 1) or own(1, 0) & own(0, 1)
    line, name, side = linededup.names(["x" * 22, "y" * 100], 4, 20, linededup.EDIT_CHARS)
    assert [int((line == k).sum()) for k in (0, 1)] == [2, 13]


def test_later_lines_of_a_large_family(monkeypatch):
    """Lines that share a name but differ in many words are told apart without the edit distance of each pair."""
    import pyarrow as pa

    r = random.Random(8)
    base = words(60, 5)
    lines = []
    for k in range(300):
        t = base[:20] + [r.choice(base) if r.random() < 0.1 else w for w in base[20:]]
        lines.append(" ".join(t))
        if k % 10 == 0:
            lines.append(lines[-1][:-1] + "!?")
    lines = sorted(set(lines), key=lambda x: r.random())
    n = len(lines)
    brute = {j for j in range(n) for i in range(j) if abs(len(lines[i]) - len(lines[j])) <= 4 and linededup.within_edits([lines[i]], [lines[j]], 4)[0]}
    zero, number = pa.array([0] * n, pa.int32()), pa.array(range(n), pa.int64())
    columns = {"key": pa.array([7] * n, pa.int64()), "bi": zero, "bj": zero, "mine": zero, "side": zero, "h1": number, "h2": number, "none": zero, "d": number, "t": number, "no": number}
    batch = pa.RecordBatch.from_pydict({**columns, "line": pa.array(lines)})
    verified, distances = [], linededup.within_edits
    monkeypatch.setattr(linededup, "within_edits", lambda a, b, *rest: verified.append(len(a)) or distances(a, b, *rest))
    got = [k for out in linededup._later_lines(4)(iter([batch])) for k in out.column("h1").to_pylist()]
    assert sorted(got) == sorted(brute) and len(brute) >= 25
    assert sum(verified) < 1_000


def test_line_dedup(docs, empty):
    rows = make_rows()
    order = sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows if r[1] is not None}, key=lambda k: (k[0], k[1]))
    seen, want = {}, {}
    for none, d, text in order:
        keep = []
        for line in text.split("\n"):
            if len(line) >= 20 and (line in seen or any(abs(len(line) - len(x)) <= 1 and distance(line, x) <= 1 for x in seen if x[:3] == line[:3] or x[-3:] == line[-3:])):
                seen.setdefault(line, 1)
                continue
            if len(line) >= 20:
                seen[line] = 1
            keep.append(line)
        want[None if none else d, text] = "\n".join(keep)
    got = linededup.dedup_lines(docs).collect()
    assert len(got) == len(rows)
    left = collections.Counter((r.doc_id, r.text) for r in got)
    assert left == collections.Counter((r[0], want[r[0], r[1]] if r[1] is not None else None) for r in rows)
    assert linededup.cleaned(docs).columns == docs.columns
    assert linededup.dedup_lines(empty).collect() == []


def test_registered_line_edits(spark, tmp_dir):
    import corpus_pipeline
    from flowlens.llm.queries import QUERIES

    line = "the quick brown fox jumps over 17 lazy dogs and the cat"
    near = [line.replace("17", "42"), line.replace("and", "with"), line.replace("fox", "fox on"), line.replace("the cat", "a cat")]
    far = line.replace("quick", "entirely")
    rows = [(1, f"first document here\n{line}")] + [(2 + i, f"own text of document {'abcdefgh'[i] * 9}\n{x}") for i, x in enumerate([*near, far])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_dir}/documents.parquet")
    want = {d: text.split("\n")[0] if text.split("\n")[1] in near else text for d, text in rows}
    assert {r.doc_id: r.text for r in QUERIES["op10_line_edit_join"](spark, tmp_dir).collect()} == want
    stage = corpus_pipeline.lines(spark, spark.read.parquet(f"{tmp_dir}/documents.parquet"), tmp_dir)
    assert {r.doc_id: r.text for r in stage.collect()} == want


def test_registered_edits_against_all_pairs(spark):
    """Four edits on random lines, each checked against every earlier one."""
    r = random.Random(11)
    base = [" ".join("".join(r.choice("abcdeé12") for _ in range(r.randrange(1, 8))) for _ in range(r.randrange(5, 14))) for _ in range(40)]
    lines = []
    for _ in range(260):
        t = list(r.choice(base))
        for _ in range(r.randrange(6)):
            k = r.randrange(len(t))
            t[k : k + r.choice([0, 1])] = r.choice(["", "x", "y", " "])
        lines.append("".join(t))
    rows = [(k, "\n".join(lines[k : k + 4])) for k in range(0, 260, 4)]
    seen, want = [], {}
    for d, text in rows:
        keep = []
        for line in text.split("\n"):
            near = lambda x: distance(line, x) <= min(4, max(1, min(len(line), len(x)) // 12))
            gone = line in seen or len(line) >= 20 and any(len(x) >= 20 and abs(len(line) - len(x)) <= 4 and near(x) for x in seen)
            keep += [] if gone and line.strip() else [line]
            seen.append(line)
        want[d] = keep
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), linededup.WORD_EDITS).collect()
    assert {x.doc_id: x.text for x in got} == {d: "\n".join(keep) for d, keep in want.items()}
    assert sum(map(len, want.values())) < 200


def test_short_lines_may_differ_in_a_number(spark):
    text = "Order number 20240117-{} was shipped"
    rows = [(1, text.format(9842) + "\nx"), (2, text.format(5531) + "\ny"), (3, text.format(9843) + "\nz")]
    got = {x.doc_id: x.near_dropped for x in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), linededup.WORD_EDITS).collect()}
    assert got == {1: 0, 2: 0, 3: 1}


def test_short_equal_lines(spark):
    rows = [(1, "Wh the.\nfirst\n\nWh the.\n\nWh the"), (2, "first\nWh the."), (3, "Wh the.\nown\n \n"), (4, "Wh thy.")]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.text, r.exact_dropped, r.near_dropped, r.kept) for r in got} == {
        1: ("Wh the.\nfirst\n\n\nWh the", 1, 0, True), 2: ("", 2, 0, False), 3: ("own\n \n", 1, 0, True), 4: ("Wh thy.", 0, 0, True)
    }


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    rows = make_rows()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = collections.Counter()
    for r in rows:
        sums[r[3]] += size(r[1])
    order = sorted(sums, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free = {}, set(order)
    while True:
        left, total = sum(sums.values()) - sum(target.values()), sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * left > 3 * sums[s] * total}
        if not over:
            break
        target |= {s: 3 * sums[s] for s in over}
        free -= over
    target |= {s: weight[s] * left / total for s in free}
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sums[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    for s in order:
        assert abs(taken[s] - target[s]) <= max(size(r[1]) for r in rows if r[3] == s)
    assert collections.Counter((r.doc_id, r.copies) for r in got) == collections.Counter((r.doc_id, r.copies) for r in mixing.mix(docs).collect())
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got if r.copies)
    assert mixing.mix(empty).collect() == []


def test_sharding(docs, empty):
    got, rows = sharding.shard_documents(docs).collect(), make_rows()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter(
        (r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows
    )
    for _, part in itertools.groupby(sorted(got, key=lambda r: (r.shard, r.slot)), key=lambda r: r.shard):
        part = list(part)
        assert [r.slot for r in part] == list(range(len(part)))
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
    assert sharding.shard_documents(empty).collect() == []


def test_differencing_is_tight():
    r = random.Random(1)
    sizes = [r.randrange(1, 10_000) for _ in range(500)]
    sums = collections.Counter()
    for s, shard in zip(sizes, sharding.differencing(sizes, 7)):
        sums[shard] += s
    assert max(sums.values()) - min(sums.values()) <= 20 and sum(sums.values()) == sum(sizes)


def test_bpe(docs, empty):
    import public_tokenizers
    import tiktoken

    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load().ranks, special_tokens={})
    got = bpe.encode_documents(docs, with_ids=True)
    texts = collections.Counter((r[0], r[1] or "") for r in make_rows())
    want = collections.Counter()
    for (d, t), n in texts.items():
        ids = e.encode_ordinary(t)
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += n
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == want
    back = collections.Counter((r.doc_id, bytes(r.bytes).decode()) for r in bpe.decode_documents(got).collect())
    assert back == texts
    assert bpe.encode_documents(empty).collect() == []
    r, own = random.Random(3), bpe.load()
    for alphabet in ("ab", " \n\t ", "theinganLYS$-=*#'1", "éß😀中 a"):
        for n in (1, 7, 90, 700):
            s = "".join(r.choice(alphabet) for _ in range(n))
            assert own.encode(s) == e.encode_ordinary(s) and own.decode(own.encode(s)) == s.encode()


def test_vectors(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(12, 16))
    v = np.repeat(centre, 6, axis=0) + rng.normal(size=(72, 16)) * 0.15
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(100 + i, v[0].tolist(), 2) for i in range(5)]
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * 16, 1), (203, [float("nan")] * 16, 1), (204, [None] + [1.0] * 15, 1), (205, [1.0, 2.0], 1), (206, [2.0, 4.0], 1)]
    schema = "vec_id long, embedding array<float>, id int"
    df = spark.createDataFrame(rows, schema)
    sound = {i: np.array(x, np.float32).astype(float) for i, x, _ in rows if x and None not in x and np.isfinite(x).all() and any(x)}
    cosine = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b) if len(a) == len(b) else -1
    pairs = [(a, b) for a, b in itertools.combinations(sound, 2) if cosine(sound[a], sound[b]) >= 0.9]
    want, links = components(pairs, [r[0] for r in rows]), collections.Counter(x for p in pairs for x in p)
    got = {r.vec_id: r for r in pstable.near_vectors(df, miss=1e-6).collect()}
    assert len(got) == len(rows) and {i: r.n_links for i, r in got.items()} == {i: links[i] for i in want}
    assert {i: r.component_id for i, r in got.items()} == want
    assert pstable.near_vectors(spark.createDataFrame([], schema)).collect() == []

    whole = {i: np.floor(64 * x) for i, x in sound.items()} | {202: np.zeros(16), 201: np.zeros(0)}
    score = lambda a, b: int(whole[a] @ whole[b])
    want = []
    for q in (i for i in whole if i % 20 == 0):
        best = sorted((-score(q, x), x) for x in whole if x != q and len(whole[x]) == len(whole[q]))[:20]
        want += [(q, k, x, -s) for k, (s, x) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in pivots.top_products(df).collect()) == sorted(want)
    assert pivots.top_products(spark.createDataFrame([], schema)).collect() == []


def test_warc(spark):
    big = "<html>" + "x\r\n\r\ny" * 300 + "é</html>"
    rows = [(1, "http://a/ b", big, 1), (2, None, big, 1), (3, "http://c", big, 1), (3, "http://c", big, 1), (4, "", None, 1), (5, "u", "", 1), (6, "u", "short", 1), (7, "u", "short", 1)]
    rows += [(None, "n", big, 1), (9, "http://z", "WARC/1.1\r\n" * 200, 1)]
    schema = "page_id long, url string, html string, record_type int"
    got = warc.convert_pages(spark.createDataFrame(rows, schema).repartition(3)).collect()
    want = []
    for p, _, h, _ in rows:
        raw = (h or "").encode()
        again = len(raw) >= 1000 and h == big and p != 3
        want.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert warc.convert_pages(spark.createDataFrame([], schema)).collect() == []
    v1 = (warc.filedesc(1, "a.arc") + "\nhttp://x 1.2.3.4 20200102030405 text/html 5\nab\ncd\n").encode()
    assert [(v, f["URL"], b) for v, f, b in warc.read_arc_records(v1)] == [(1, "http://x", b"ab\ncd")]
    with pytest.raises(ValueError, match="declared length"):
        list(warc.read_arc_records(v1[:-4]))


def test_quality_and_toxicity(spark, empty):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(500):
        text = ". ".join(" ".join(words(r.randrange(6, 14), 1000 * i + k)) for k in range(r.randrange(3, 8)))
        good, bad = r.random() < 0.8, r.random() < 0.25
        if not good:
            text = " ".join(f"{w}***" for w in text.split()) if i % 2 else (text.split()[0] + " ") * 60
        if bad:
            text += f". you are scumbag{r.choice(['', 'ly', 'gery'])} here."
        rows.append((i, text))
        labels.append((i, int(good), int(bad)))
    rows += [(900, None), (901, ""), (None, "alpha beta")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1, 1), (902, None, None)], "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in labels}
    for k, (score, folds, out) in enumerate(((pulearn.quality_scores, 3, 1), (crf.toxicity_scores, 5, 0))):
        got = score(docs, known).collect()
        assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
        held = [x for x in got if x.held_out and x.doc_id in truth]
        assert all((zlib.crc32(str(x.doc_id).encode()) % folds == out) == x.held_out for x in got if x.doc_id is not None)
        assert np.mean([x.predicted == truth[x.doc_id][k] for x in held]) >= 0.9
        assert score(empty, known.limit(0)).collect() == []
        assert {x.score for x in score(docs, known.limit(0)).collect()} <= {0.5 if k == 0 else 0.0}
    spans = {x.doc_id: x.spans for x in crf.toxicity_scores(docs, known).collect() if x.doc_id in truth and truth[x.doc_id][1] and x.predicted}
    texts = dict(rows)
    assert np.mean([any("scumbag" in texts[d][s.start : s.end] for s in found) for d, found in spans.items()]) >= 0.9


def test_large_components_are_exact(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(20, [1.0, 2.0]), (21, [16383.9, 0.5]), (22, [float("inf"), 1.0]), (None, [1e9, 1.0])]
    assert [r.vec_id for r in pivots.top_products(spark.createDataFrame(rows, schema)).collect()] == [21]
    r = random.Random(7)
    sizes = [1.0, 0.3, 3e4, 2.0**23, -1e6]
    rows = [(i, [r.choice(sizes) * r.uniform(-1, 1) for _ in range(6)]) for i in range(120)] + [(200, [2.0**23 + 1 / 64] * 6), (201, [2.0**23] * 6)]
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    want = []
    for i, q in whole:
        if i % 20 == 0:
            best = sorted((-sum(map(mul, q, v)), j) for j, v in whole if j != i)[:20]
            want += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert sorted(map(tuple, pivots.top_products(spark.createDataFrame(rows, schema)).collect())) == sorted(want)
    with pytest.raises(Exception, match="beyond 64 bits"):
        pivots.top_products(spark.createDataFrame([(0, [1e15, 1.0]), (1, [1e15, 2.0])], schema)).collect()


def test_minhash_shared_and_missing_ids(spark):
    """Two texts under one doc_id are two documents; documents without doc_id link as any other."""
    a, b = words(60, 31), words(60, 32)
    near = lambda w: " ".join([*w[:-1], "changed"])
    one, two = " ".join(a), " ".join(b)
    got = minhash.near_duplicates(spark.createDataFrame([(1, one), (1, two), (2, near(a)), (3, near(b))], "doc_id long, text string"))
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got.collect()) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]
    third = " ".join(words(60, 33))
    rows = [(None, one), (None, near(a)), (None, near(a)), (None, two), (9, near(b)), (None, third)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter(r.component_id for r in got) == {None: 4, 9: 2}
    # of the first group (two texts, one of them twice) one text is kept, of the second document 9, and the lone one
    assert sum(r.kept for r in got if r.component_id == 9) == 1 and sum(r.kept for r in got if r.component_id is None) in (2, 3)
    # a text without doc_id joins its neighbours, which are too far from each other
    chain = [a[:40] + [f"x{k}" for k in range(3)] + a[43:], a, a[:10] + [f"y{k}" for k in range(3)] + a[13:]]
    got = minhash.near_duplicates(spark.createDataFrame([(4, " ".join(chain[0])), (None, " ".join(chain[1])), (6, " ".join(chain[2]))], "doc_id long, text string"))
    ends = shingles(" ".join(chain[0])), shingles(" ".join(chain[1])), shingles(" ".join(chain[2]))
    linked = [100 * len(x & y) >= 75 * len(x | y) for x, y in ((ends[0], ends[1]), (ends[1], ends[2]), (ends[0], ends[2]))]
    assert linked == [True, True, False]
    assert {r.component_id for r in got.collect()} == {4}


def test_one_of_each_group(spark):
    schema = "doc_id long, text string, _kept string, d int, k int, row string"
    a, b = " ".join(words(60, 41)), " ".join(words(60, 42))
    rows = [(None, a), (1, a), (None, None), (2, a + " more"), (3, b), (3, a), (None, None), (5, ""), (6, "")]
    docs = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], schema)
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, a), (3, b), (None, None), (5, ""), (6, "")], key=str)
    # a group without any doc_id keeps one text
    kept = minhash.one_of_each(spark.createDataFrame([(None, a), (None, a + " more"), (None, a)], "doc_id long, text string")).collect()
    assert len(kept) == 1


def plain_mix(rows, epochs=3, seed=mixing.SEED):
    """Copies of each (doc_id, source, size) by the rule, one source at a time."""
    names = sorted({s for _, s, _ in rows if s is not None}) + ([None] if any(s is None for _, s, _ in rows) else [])
    size = {s: sum(n for _, t, n in rows if t == s) for s in names}
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    free, total = set(names), sum(size.values())
    while True:
        left = total - sum(epochs * size[s] for s in names if s not in free)
        over = {s for s in free if weight[s] * left > epochs * size[s] * sum(weight[t] for t in free)}
        if not over:
            break
        free -= over
    target = {s: weight[s] * float(left) / float(sum(weight[t] for t in free)) if s in free else float(epochs * size[s]) for s in names}
    out = {}
    for s in names:
        mine = sorted((hashlib.md5(f"{seed}:{'null' if d is None else d}".encode()).hexdigest(), n, d) for d, t, n in rows if t == s)
        whole = math.floor(target[s] / size[s]) if size[s] else 0
        rest = target[s] - whole * size[s]
        for draw, n, d in mine:
            after = sum(m for x, m, _ in mine if (x, m) <= (draw, n))
            out[d, s, n] = whole + (1 if rest > 0 and after - n / 2 <= rest else 0)
    return out


@pytest.mark.parametrize("torn_rows", [1 << 16, 3])
def test_mix_against_the_rule(spark, torn_rows):
    r = random.Random(5)
    rows = [(i, r.choice(["a", "b", "b", "b", "c", "", None]), r.choice([0, 1, 3, 40])) for i in range(300)]
    rows += [(None, "b", 5)] * 30 + [(400 + i, "tiny", n) for i, n in enumerate([0, 0, 2])] + [(500, "none", 0)]
    docs = spark.createDataFrame([(d, " ".join(["w"] * n), s) for d, s, n in rows], "doc_id long, text string, source string")
    want = plain_mix(rows)
    got = mixing.mix(docs, torn_rows=torn_rows).collect()
    assert len(got) == len(rows)
    assert {(x.doc_id, x.source, x.size): x.copies for x in got} == want
    assert max(x.copies for x in got) <= mixing.EPOCHS
    assert mixing.mixed_rows(docs).count() == sum(want[d, s, n] for d, s, n in rows)


def test_sources_are_numbered_in_order(spark):
    names = [f"s{k:04d}" for k in range(700)] + ["Z", "é", ""]
    table = spark.createDataFrame([(s, 1) for s in [*names, None]], "source string, source_size long").repartition(7)
    got = {r.source: r.weight for r in mixing.numbered(table).collect()}
    assert got == {s: k % 3 + 1 for k, s in enumerate([*sorted(names), None])}


def test_archives_are_of_bounded_size(spark, monkeypatch):
    """Files end after a number of rows and are filled up when they have their bytes; small payloads share no partition."""
    monkeypatch.setattr(warc, "ARCHIVE_ROWS", 9)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 6000)
    archive, rows = warc.Archive(), []
    for k in range(40):
        if archive.opens():
            rows += archive.add(b"start")
        rows += archive.add(b"x" * (1000 if k < 30 else 4000))
    files = [rows[i : i + 9] for i in range(0, len(rows), 9)]
    assert all(f[0] == b"start" for f in files) and sum(x not in (b"", b"start") for x in rows) == 40
    assert all(sum(map(len, f)) <= 6000 + 4000 for f in files)


def test_small_payloads_are_spread(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "small" if i % 2 else None) for i in range(400)], "page_id long, url string, html string")
    base = common.scratch_path(spark, "arc-test")
    warc.write_arc(pages.repartition(3), base + "-arc")
    other = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in other}
    for k, v in other.items():
        spark.conf.set(k, v)
    try:
        warc.convert(spark, base + "-arc", base + "-warc")
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert warc.read_warc(spark, base + "-warc").count() == 400
    archives = spark.read.format("binaryFile").load(base + "-warc").where("length > 0").select("length").collect()
    assert len(archives) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(a.length for a in archives) < 0.4 * sum(a.length for a in archives)


def test_samples_take_one_row_of_a_doc_id(spark):
    """A doc_id that stands many times brings one text (the smallest) to the fit, so the model is that of single rows."""
    own = [(i, " ".join(words(30, i)) + (" you vile filthy lot" if i % 2 else "")) for i in range(2, 60)]
    schema = "doc_id long, text string"
    once = spark.createDataFrame([(1, "aa first text"), *own], schema)
    often = spark.createDataFrame([(1, "aa first text")] + [(1, f"repeated text {i}") for i in range(500)] + own, schema).repartition(5)
    good = once.where("doc_id < 30").select("doc_id")
    known = once.selectExpr("doc_id", "cast(doc_id % 2 as int) AS toxic")
    assert pulearn.learn(often, good) == pulearn.learn(once, good)
    assert crf.learn(often, known) == crf.learn(once, known)


def test_chain_marginals_against_all_taggings():
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 7):
        model = crf.Crf()
        model.move, model.begin = r.normal(size=(2, 2)), r.normal(size=2)
        unary = r.normal(size=n)
        p, moves, first = model.marginals(unary, np.array([0]), np.array([n]), True)
        total, want, steps, begins = 0.0, np.zeros(n), np.zeros((2, 2)), np.zeros(2)
        for tags in itertools.product((0, 1), repeat=n):
            weight = math.exp(float(unary @ np.array(tags)) + model.begin[tags[0]] + sum(model.move[a, b] for a, b in zip(tags, tags[1:])))
            total += weight
            want += weight * np.array(tags)
            begins[tags[0]] += weight
            for a, b in zip(tags, tags[1:]):
                steps[a, b] += weight
        assert np.allclose(p, want / total) and np.allclose(first, begins / total)
        assert n == 1 or np.allclose(moves, steps / total)


def test_network_gradient_against_difference_quotients():
    r = np.random.default_rng(4)
    net = pulearn.Network(6)
    z, dg = r.normal(size=(9, 6)), r.normal(size=9)
    for w, g in zip(net.w, net.gradient(z, dg)):
        for at in np.ndindex(w.shape):
            was = w[at]
            w[at] = was + 1e-6
            up = net.output(z) @ dg
            w[at] = was - 1e-6
            down = net.output(z) @ dg
            w[at] = was
            assert math.isclose((up - down) / 2e-6, g[at], rel_tol=1e-4, abs_tol=1e-6)


def test_vectors_near_the_threshold_are_found(spark):
    """Recall of the registered parameters on planted pairs with cosines of 0.9 to 0.93."""
    r, rows, pairs = np.random.default_rng(6), [], []
    for k in range(300):
        a = r.normal(size=64)
        a /= np.linalg.norm(a)
        b = r.normal(size=64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = r.uniform(0.9001, 0.93)
        rows += [(2 * k, a.tolist()), (2 * k + 1, (c * a + math.sqrt(1 - c * c) * b).tolist())]
        pairs.append((2 * k, 2 * k + 1))
    got = {x.vec_id: x for x in pstable.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    found = sum(got[b].component_id == a for a, b in pairs)
    assert found >= 0.95 * len(pairs) and all(x.n_links <= 1 for x in got.values())


def test_shard_balance(docs):
    """Bytes of the shards differ by less than the largest document; every document stands in one shard."""
    rows = sharding.shard_documents(docs).collect()
    sizes = collections.Counter()
    for x in rows:
        sizes[x.shard] += x.size
    assert len(rows) == len(make_rows())
    if rows[0].law == "bytes":
        spread = max(sizes.get(k, 0) for k in range(24)) - min(sizes.get(k, 0) for k in range(24))
        assert spread <= max(x.size for x in rows)
