"""Word runs, SentencePiece rounds and cross-tokenizer alignment against plain versions and the public libraries."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from flowlens.llm import crosstoken, pieces, wordruns
from flowlens.llm.queries import QUERIES, periodic_tail
from tests.conftest import SF_SMALL
from tests.llm.test_operators import DOCS

SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
HF = Tokenizer.from_file(public_tokenizers.path(crosstoken.BYTE_LEVEL))
HF.encode_special_tokens = True
LETTERS, ENTRY = crosstoken.byte_letters(), {i: t for t, i in HF.get_vocab().items()}

PARTS = ["a", "b", "th", "the", " ", "  ", "\n", "\t", "é", "日本", "語", "\U0001f600", "<0x41>", "<s>", "</s>", "<unk>", "<|endoftext|>", "=", "==", "0", "12"]
PARTS += ["\x00", "\xa0", "　", "ing", "ll", "AB", "\r", " \n", " foo", " Bar", "\x1f", " ", "'s", "​"]


def mixed(n, seed, parts=PARTS, longest=40):
    r = random.Random(seed)
    return ["".join(r.choice(parts) for _ in range(r.randrange(longest))) for _ in range(n)]


def rows_of(texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (None, None), (7, None), (3, texts[3]), (3, texts[3]), (8, "")]
    return [(d, t, "en", None, 0, 1, "x", 0.5) for d, t in rows]


# --- runs -------------------------------------------------------------------------------


def plain_runs(w, least=12):
    """Every maximal stretch of each period, without those that have a smaller period."""
    out = []
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            stretch = w[i : j + p]
            if len(stretch) >= max(least, 2 * p) and not any(stretch[q:] == stretch[:-q] for q in range(1, p)):
                out.append((i, len(stretch), p))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_runs_against_all_periods():
    r = random.Random(1)
    lists = []
    for _ in range(1200):
        n, k = r.randrange(70), r.choice([1, 2, 2, 3, 5])
        w = [r.randrange(k) for _ in range(n)]
        if n > 4 and r.random() < 0.4:
            a = r.randrange(n)
            p = r.randrange(1, max(2, (n - a) // 2 + 1))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert wordruns.runs_of(np.array(w, np.int64), 2) == plain_runs(w, 2)
        lists.append([b"w%d" % x for x in w])
    # many rows at once, cut into stretches first
    assert wordruns.find_runs(lists) == [plain_runs(w) for w in lists]


def test_long_and_regular_words():
    n = 30_000
    assert wordruns.runs_of(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert wordruns.runs_of(np.arange(n) % 700) == [(0, n, 700)]
    assert wordruns.runs_of(np.arange(n)) == []


def test_run_rows(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice("abc") for _ in range(r.randrange(60))) for _ in range(40)] + ["a b c d e f " * 4, "x\ty\x0bz\n" * 6, "a b " * 15, "A a " * 9]
    got = wordruns.periodic_runs(spark.createDataFrame(rows_of(texts), DOCS)).collect()
    assert len(got) == len(rows_of(texts))
    want = []
    for d, t, *_ in rows_of(texts):
        words = (t or "").encode().split()
        runs = plain_runs(words)
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        want.append((d, tuple(runs), " ".join(w.decode() for i, w in enumerate(words) if i not in gone)))
    assert sorted(map(repr, want)) == sorted(repr((x.doc_id, tuple(tuple(y) for y in x.runs), x.collapsed)) for x in got)
    assert wordruns.periodic_runs(spark.createDataFrame([], DOCS)).collect() == []


def test_run_query(spark):
    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    checked = planted = 0
    for x in QUERIES["op11_automaton_runs"](spark, SF_SMALL).collect():
        words = (docs[x.doc_id] or "").encode().split()
        h, n = crc32(str(x.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        assert periodic_tail(x.doc_id, (docs[x.doc_id] or "").encode().split()) == words
        if n > 900:
            continue
        checked += 1
        runs = plain_runs(words)
        gone = {i for s, m, p in runs for i in range(s + p, s + m)}
        best = min(((-m, s, p) for s, m, p in runs), default=None)
        head = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        assert (x.n_runs, x.start, x.length, x.period, x.exponent_milli) == (len(runs), *head)
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
    assert checked > 100 and planted > 5


# --- SentencePiece ------------------------------------------------------------------------


def test_pieces_against_the_library():
    own = pieces.load()
    texts = mixed(4000, 5, [*PARTS, "▁", "▁▁"]) + [" " * k for k in range(40)] + ["a" * k for k in range(40)] + ["=" * k for k in range(150)]
    texts += ["ab" * 300, " " * 4000, "x" * 4000, "", "日本語" * 500, "".join(map(chr, range(0x20, 0x2000)))]
    ids, at = own.encode(texts)
    for i, want in enumerate(SP.encode(texts, num_threads=1)):
        assert ids[at[i] : at[i + 1]].tolist() == want, texts[i][:80]
        assert own.decode(want) == SP.decode(want)
    r = random.Random(6)
    for _ in range(5000):  # ids that no text gives: broken bytes, control and unknown pieces
        some = [r.randrange(32_000) if r.random() < 0.3 else r.randrange(260) for _ in range(r.randrange(12))]
        assert own.decode(some) == SP.decode(some)


def test_words_at_once_and_one_by_one():
    own = pieces.load()
    for word in mixed(300, 8, ["t", "h", "e", "in", "ing", "▁", "aa", "1", "="], 30):
        sym = own.symbol[[ord(c) for c in word]].tolist()
        want = own._one_by_one(sym)[1] if sym else []
        ids, _ = own.encode_words([word])
        assert [x for x in ids.tolist() if x >= 259] == [x for x in want if 259 <= x < own.n]


def test_forgetting_words_changes_nothing(monkeypatch):
    own, texts = pieces.load(), mixed(60, 9)
    whole = own.encode(texts)[0].tolist()
    monkeypatch.setattr(pieces, "KNOWN_WORDS", 3)
    assert [x for t in texts for x in own.encode([t])[0].tolist()] == whole


def test_piece_rows(spark):
    texts = mixed(60, 10)
    got = pieces.encode_documents(spark.createDataFrame(rows_of(texts), DOCS), with_text=True)
    want = [(d, SP.encode(t or ""), SP.decode(SP.encode(t or ""))) for d, t, *_ in rows_of(texts)]
    assert sorted(map(repr, want)) == sorted(repr((x.doc_id, x.ids, x.decoded)) for x in got.collect())
    back = pieces.decode_documents(got.withColumnRenamed("decoded", "was")).collect()
    assert sorted(repr((d, t)) for d, _, t in want) == sorted(repr((x.doc_id, x.decoded)) for x in back)
    assert pieces.encode_documents(spark.createDataFrame([], DOCS)).collect() == []


def test_piece_query(spark):
    docs = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for x in QUERIES["op12_piece_rounds"](spark, SF_SMALL).collect():
        ids = SP.encode(docs[x.doc_id])
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(SP.decode(ids)))


# --- alignment ----------------------------------------------------------------------------


def plain_tokens(text):
    """(id, first byte, end) of either kind; none where the bytes differ from a space and the text."""
    if not text:
        return [], []
    a = [(i, bytes(LETTERS[c] for c in ENTRY[i])) for i in HF.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[1:-1], 16)]) if SP.is_byte(i) else p.replace("▁", " ").encode()) for i in SP.encode(text) for p in [SP.id_to_piece(i)]]
    if any(b"".join(x for _, x in side) != (" " + text).encode() for side in (a, b)):
        return [], []
    ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
    return tuple([(i, e - len(x), e) for (i, x), e in zip(side, end)] for side, end in zip((a, b), ends))


def plain_alignment(texts):
    rows, hold = [], Counter()
    for t in texts:
        a, b = plain_tokens(t)
        common = sorted({x[2] for x in a} & {x[2] for x in b})
        groups = []
        for lo, hi in zip([0, *common], common):
            groups.append("|".join(",".join(str(i) for i, s, e in side if lo <= s and e <= hi) for side in (a, b)))
        links = [(i, j) for i, s, e in a for j, u, v in b if s < v and u < e]
        hold.update(set(links))
        rows.append((len(a), len(b), len(common), len(links), ";".join(groups), links))
    best = defaultdict(int)
    for (a, _), n in hold.items():
        best[a] = max(best[a], n)
    return [(*x[:5], sum(hold[p] == best[p[0]] for p in x[5]), sum(hold[p] for p in x[5])) for x in rows]


def test_fragments_join_in_any_tree():
    both, r = crosstoken.load(), random.Random(4)
    for text in mixed(150, 12, longest=150):
        want = plain_alignment([text])[0]
        tokens = both.segment(" " + text, 0) if text else crosstoken.Open()
        if tokens is None:
            assert want[0] == 0
            continue
        n = len((" " + text).encode()) if text else 0
        cuts = sorted(r.randrange(n + 1) for _ in range(r.randrange(12)))

        def tree(parts):
            if len(parts) == 1:
                return parts[0]
            k = r.randrange(1, len(parts))
            return tree(parts[:k]) + tree(parts[k:])

        got = tree([crosstoken.Fragment.of(tokens.cut(x, y)) for x, y in zip([0, *cuts], [*cuts, n])]).whole()
        assert (got.n_a, got.n_b, got.n_groups, int(got.times.sum()), got.groups) == want[:5]


@pytest.mark.parametrize(("chunk", "block"), [(crosstoken.CHUNK, crosstoken.BLOCK), (300, 500)])
def test_alignment_rows(spark, chunk, block):
    """Small chunks send most texts through segments, fragments and rounds; small blocks share the pair counts."""
    texts = mixed(150, 13) + ["x▁y a", "日本語" * 60, " ".join(mixed(40, 14)), "the same words " * 60, "ab" * 400]
    rows = rows_of(texts) + [(900, texts[-2], "en", None, 0, 1, "x", 0.5)] * 2
    aligned = crosstoken.align_documents(spark.createDataFrame(rows, DOCS).repartition(5), chunk=chunk)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")
    got = [tuple(x[c] for c in names) for x in crosstoken.with_pair_counts(aligned, block).collect()]
    same = crosstoken.count_links(spark.createDataFrame(rows, DOCS).repartition(4), str.upper, chunk=chunk, block=block).collect()
    assert sorted(repr(tuple(x[c] for c in names)) for x in same) == sorted(map(repr, got))  # digits and signs have no case
    want = [(r[0], *x) for r, x in zip(rows, plain_alignment([r[1] or "" for r in rows]))]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_no_rows_to_align(spark):
    assert crosstoken.with_pair_counts(crosstoken.align_documents(spark.createDataFrame([], DOCS))).collect() == []


def test_alignment_query(spark):
    docs = [(x.doc_id, x.text or "") for x in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect() if len(x.text or "") < 10**9]
    both = crosstoken.load()
    hold, rows = Counter(), {}
    for d, t in docs:
        tokens = both.segment(" " + t, 0) if t else crosstoken.Open()
        rows[d] = crosstoken.Fragment.of(tokens).whole()
        hold.update(rows[d].pairs.tolist())
    best = defaultdict(int)
    for p, n in hold.items():
        best[p >> 32] = max(best[p >> 32], n)
    got = QUERIES["op13_fragment_alignment"](spark, SF_SMALL).collect()
    assert len(got) == len(docs)
    for x in got:
        f = rows[x.doc_id]
        links = list(zip(f.pairs.tolist(), f.times.tolist()))
        assert (x.n_a, x.n_b, x.n_groups, x.n_links) == (f.n_a, f.n_b, f.n_groups, int(f.times.sum()))
        assert x.n_best == sum(m for p, m in links if hold[p] == best[p >> 32])
        assert x.count_sum == sum(m * hold[p] for p, m in links)
        assert x.groups_sha256 == (hashlib.sha256(f.groups.encode()).hexdigest() if f.groups else "")


def test_lone_spaces_is_the_pattern():
    import re

    from flowlens.llm.common import lone_spaces

    pattern = re.compile(r"\s | \s|^ | $")
    blanks = [chr(i) for i in range(0x110000) if re.match(r"\s", chr(i))]
    texts = ["", "a", "a b", " a", "a ", "  ", "a\nb c", *(f"a{c} b" for c in blanks), *(f"a {c}b" for c in blanks), *(f"a{c}b c" for c in blanks)]
    assert [lone_spaces(t) for t in texts] == [pattern.search(t) is None for t in texts]


def test_long_alignments_share_no_task_between_python_steps(spark):
    """Steps in Python behind each other in one task hold a worker each, which took the check's executor memory."""
    from flowlens.llm import crosstoken as ct

    words = " ".join(f"word{i % 37} ({i})" for i in range(400))
    rows = [(1, words), (1, words), (2, "x" + words), (3, "short text"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    done = ct.count_links(docs, str, chunk=256)
    whole = ct._whole(ct._by_length(docs, 256)[1], ct.BYTE_LEVEL, ct.pieces.MODEL, 256)
    plan = whole._jdf.queryExecution().analyzed().toString()
    assert "InArrow" not in plan and "InPandas" not in plan  # the joined fragments are read from a stored table
    seen = sorted(tuple(r) for r in done.select("doc_id", "n_a", "n_b", "n_groups", "groups", "n_best", "count_sum").collect())
    plain = ct.count_links(docs, str, chunk=1 << 16)
    assert seen == sorted(tuple(r) for r in plain.select("doc_id", "n_a", "n_b", "n_groups", "groups", "n_best", "count_sum").collect())
    assert len(seen) == 5 and seen[0] == seen[1]
