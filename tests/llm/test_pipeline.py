"""The pipeline end to end on the smallest tables: columns between stages, one document of each group, round trips."""

from __future__ import annotations

import hashlib
import random

import duckdb

import corpus_pipeline
from flowlens.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF_SMALL
from tests.llm.test_operators import components, plain_mix, shingles


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF_SMALL), f"test-{name}")
        assert docs.columns == columns
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL)
    assert 0 < docs.select("doc_id").distinct().count() <= before
    assert last.count() == docs.count()


def plain_lines(docs):
    """Lines that equal an earlier one go; documents that lose lines and have only blank ones left go."""
    seen, out = set(), []
    for d, text, source in docs:
        parts, rest = text.split("\n"), []
        for x in parts:
            if x.strip() and x in seen:
                continue
            seen.add(x)
            rest.append(x)
        if len(rest) == len(parts) or any(x.strip() for x in rest):
            out.append((d, "\n".join(rest), source))
    return out


def plain_groups(docs):
    """One document of each group of near copies, by all pairs."""
    sets = [shingles(t) for _, t, _ in docs]
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    root = components(pairs, range(len(docs)))
    return [docs[i] for i in sorted(set(root.values()))]


def test_stages_against_plain_python(spark):
    """The stages behind the classifier, each on what the one before kept; the text has no near lines that are not equal."""
    r = random.Random(17)
    word = lambda: "".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(r.randrange(2, 5)))
    line = lambda: " ".join(word() for _ in range(14))
    junk = [line() for _ in range(3)]
    docs = []
    for d in range(60):
        lines = [line() for _ in range(r.randrange(2, 6))] + r.sample(junk, r.randrange(3)) + [""]
        docs.append((d, "\n".join(lines), r.choice(["a", "b", "c"])))
    # near copies that share no line: the words of some lines run on over other line ends
    for k, d in enumerate((3, 11, 29)):
        words = docs[d][1].split()
        docs.append((100 + k, "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)), "c"))
    docs += [(200, docs[5][1], "a"), (201, "\n".join(junk), "b")]
    schema = "doc_id long, text string, source string, n_chars long"
    table = spark.createDataFrame([(*d, len(d[1])) for d in docs], schema)
    rows = lambda t: sorted((x.doc_id, x.text, x.source) for x in t.collect())
    stages = dict(corpus_pipeline.STAGES)
    lines = stages["lines"](spark, table, SF_SMALL)
    want = plain_lines(docs)
    assert lines.columns == table.columns and rows(lines) == sorted(want)
    assert all(x.n_chars == len(x.text) for x in lines.collect())
    near = stages["near_duplicates"](spark, lines, SF_SMALL)
    want = plain_groups(want)
    assert rows(near) == sorted(want) and len(want) <= len(docs) - 3
    mix = stages["mixture"](spark, near, SF_SMALL)
    copies = plain_mix([(d, s, len(t.split())) for d, t, s in want])
    want = [(d, t, s) for d, t, s in want for _ in range(copies[d, s, len(t.split())])]
    assert rows(mix) == sorted(want)
    tokens = stages["tokens"](spark, mix, SF_SMALL).collect()
    back = sorted((x.doc_id, x.decoded_sha256) for x in tokens)
    assert back == sorted((d, hashlib.sha256(t.encode()).hexdigest()) for d, t, _ in want)


def test_run_leaves_only_its_result(spark):
    from flowlens.llm import common

    mark = common.scratch_mark(spark)
    result = corpus_pipeline.run(spark, SF_SMALL)
    assert result.count() > 0 and common.scratch_mark(spark) == mark + 1


def test_oracles(spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    for key, sql in ORACLE_SQL.items():
        want = con.execute(sql).fetchall()
        names = [d[0] for d in con.description]
        got = [tuple(r) for r in QUERIES[key](spark, SF_SMALL).select(*names).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want)), key
