"""Cleaning chain, CSV source and profile (C1-C11, S1-S3, S6, A1-A3) on literal fixtures."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from flowlens.operators import clean as cl
from flowlens.operators import profile as pr
from flowlens.sources import csv as csvsrc


def _write(path, data: bytes):
    with open(path, "wb") as fh:
        fh.write(data)
    return path


def test_normalize_and_collisions(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["  Label", "label ", " Flow Duration "])
    names, collisions = cl.normalized_names(df.columns)
    assert names == ["label", "label.1", "flow duration"]
    assert collisions == [("label ", "label.1")]
    assert cl.normalize_columns(df).columns == names


def test_detect_format(spark):
    unsw = spark.createDataFrame([(1,)], "x INT").toDF("x")
    assert cl.detect_format(unsw) == "unknown"
    df = spark.createDataFrame([("tcp", "-", "FIN", "Normal", 0)], ["Proto", "service", "STATE", "attack_cat", "label"])
    assert cl.detect_format(df) == "UNSW-NB15"
    cic = spark.createDataFrame([(80, 1, 2, "BENIGN")], [" Destination Port", "Flow Duration", "Total Fwd Packets", "Label"])
    assert cl.detect_format(cic) == "CIC-IDS2017"


def test_resolve_target(spark):
    df = spark.createDataFrame([(1, 0)], ["a", "attack_label"])
    assert "label" in cl.resolve_target(df).columns
    with pytest.raises(KeyError):
        cl.resolve_target(spark.createDataFrame([(1,)], ["a"]))


def test_coerce_at_exactly_ninety_percent(spark):
    vals = [str(i) for i in range(9)] + ["x"]  # 9 of 10 parse -> adopted
    below = [str(i) for i in range(8)] + ["x", None]  # 8 of 10 (missing counts as not parsed)
    df = spark.createDataFrame(list(zip(vals, below, [0] * 10)), ["a", "b", "label"])
    out, chosen = cl.coerce_numeric(df)
    assert chosen == ["a"]
    assert dict(out.dtypes)["a"] == "double" and dict(out.dtypes)["b"] == "string"
    assert out.filter(F.col("a").isNull()).count() == 1


def test_numeric_guard_rejects_java_suffixes(spark):
    df = spark.createDataFrame([("12d",), ("1_000",), ("inf",), ("-Infinity",), (" 5 ",), ("1e3",)], ["a"])
    from flowlens.functions.numeric import parse_number

    got = [r[0] for r in df.select(parse_number(F.col("a"))).collect()]
    assert got[0] is None and got[1] is None
    assert got[2] == float("inf") and got[3] == float("-inf") and got[4] == 5.0 and got[5] == 1000.0


def test_inf_to_null_and_counts(spark):
    df = spark.createDataFrame([(1.0, 0), (float("inf"), 0), (float("-inf"), 1), (float("nan"), 1)], "x DOUBLE, label INT")
    assert {r["column"]: r["inf_count"] for r in cl.inf_counts(df).collect()} == {"x": 2}
    assert cl.inf_to_null(df).filter(F.col("x").isNull()).count() == 3


def test_drop_duplicates_nulls_equal_and_first_id_kept(spark):
    df = spark.createDataFrame([(5, None, "a"), (3, None, "a"), (4, 1.0, "b")], "row_id BIGINT, x DOUBLE, s STRING")
    out = {(r.x, r.s): r.row_id for r in cl.drop_duplicates(df).collect()}
    assert out == {(None, "a"): 3, (1.0, "b"): 4}


def test_clean_chain_and_profile(spark):
    rows = [(1, "1", "tcp", "Normal", 0), (2, "1", "tcp", "Normal", 0), (3, "inf", "udp", "DoS", 1), (4, "x", None, "DoS", 1)]
    df = spark.createDataFrame(rows, ["id", " Rate", "proto", "attack_cat", "Label"])
    out, res = cl.clean_dataframe(df)
    assert sorted(out.columns) == ["label", "proto", "rate"]
    assert res.coerced == []  # 3 of 4 parse ('inf' counts): 'rate' stays text (75 % < 90 %)
    assert out.count() == 3  # one duplicate removed after id/attack_cat are gone
    prof = pr.dataset_profile(out, res.format, res.before_dedup).first()
    assert prof.n_rows == 3 and prof.n_cols == 3 and prof.duplicate_rows == 0 and prof.duplicates_removed == 1
    assert prof.missing_cells == 1 and prof.missing_pct == round(100 / 9, 4)
    # the one-pass form over the counted rows gives the same profile
    assert pr.dataset_profile(res.counted, res.format, copies=cl.COPIES).first() == prof
    dist = {r["label"]: r["count"] for r in pr.target_distribution(out).collect()}
    assert dist == {"0": 1, "1": 2}
    rep = pr.missing_report(out).collect()
    assert [(r["column"], r["missing_count"]) for r in rep] == [("proto", 1)]


def test_clean_unlabelled_injects_and_drops_target(spark):
    df = spark.createDataFrame([("1", "tcp"), ("1", "tcp")], ["a", "proto"])
    out, has_labels, _ = cl.clean_for_inference(df)
    assert has_labels is False and "label" not in out.columns and out.count() == 1


def test_binarize_cic_labels(spark):
    df = spark.createDataFrame([("BENIGN",), ("DDoS",), (None,)], ["label"])
    assert [r[0] for r in cl.binarize_label(df).collect()] == [0, 1, None]


def test_csv_missing_and_empty(spark, tmp_dir):
    with pytest.raises(FileNotFoundError):
        csvsrc.load_csv(spark, os.path.join(tmp_dir, "nope.csv"))
    empty = _write(os.path.join(tmp_dir, "empty.csv"), b"")
    with pytest.raises(ValueError):
        csvsrc.load_csv(spark, empty)
    header = _write(os.path.join(tmp_dir, "header.csv"), b"a,b,label\n")
    assert csvsrc.load_csv(spark, header).count() == 0


def test_csv_latin1_fallback_and_na_tokens(spark, tmp_dir):
    data = "name,city,label\nJos\xe9,M\xfcnchen,0\nNA,N/A,1\n".encode("latin-1")
    path = _write(os.path.join(tmp_dir, "latin.csv"), data)
    rows = csvsrc.load_csv(spark, path).collect()
    assert rows[0]["name"] == "José" and rows[0]["city"] == "München"
    assert rows[1]["name"] is None and rows[1]["city"] is None


def test_typed_csv_read_decodes_and_types_in_one_pass(spark, tmp_dir):
    latin = _write(os.path.join(tmp_dir, "latin.csv"), "name,n,label\nJos\xe9,1,0\nNA,2,1\n".encode("latin-1"))
    typed = csvsrc.load_csv(spark, latin, typed=True)
    assert dict(typed.dtypes) == {"name": "string", "n": "bigint", "label": "bigint"}
    assert [r["name"] for r in typed.orderBy("n").collect()] == ["José", None]
    utf8 = _write(os.path.join(tmp_dir, "utf8.csv"), "name,n,label\nJosé,1,0\nx,2.5,1\n".encode("utf-8"))
    sc = spark.sparkContext
    sc.setJobGroup("typed-csv", "decoding check and type counts together")
    typed = csvsrc.load_csv(spark, utf8, typed=True)
    jobs = list(sc.statusTracker().getJobIdsForGroup("typed-csv"))
    assert dict(typed.dtypes) == {"name": "string", "n": "double", "label": "bigint"}
    # the scan for open quotes and ONE aggregate, each with its final step (no separate scan for undecodable bytes)
    assert len([j for j in jobs if sc.statusTracker().getJobInfo(j) is not None]) <= 4
    assert [r["name"] for r in typed.orderBy("n").collect()] == ["José", "x"]


def test_load_dataset_takes_the_share_from_the_read_pass(spark, tmp_dir):
    # 'rate' parses for 9 of 10 rows (90 %: coerced), 'ttl' for 8 of 10 (stays text);
    # ' Label' is resolved as the target, 'id' and 'attack_cat' are dropped
    lines = ["id,Rate,ttl,proto,attack_cat, Label"]
    for i in range(10):
        rate = "x" if i == 0 else str(i / 2)
        ttl = "bad" if i < 2 else str(i)
        lines.append(f"{i},{rate},{ttl},{'tcp' if i % 2 else 'udp'},n,{i % 2}")
    path = _write(os.path.join(tmp_dir, "share.csv"), ("\n".join(lines) + "\n").encode())
    out, res = csvsrc.load_dataset(spark, path)
    ref, ref_res = cl.clean_dataframe(csvsrc.load_csv(spark, path, typed=True))
    assert res.coerced == ref_res.coerced == ["rate"]
    assert out.dtypes == ref.dtypes and out.count() == ref.count() == 10
    assert out.exceptAll(ref).isEmpty() and ref.exceptAll(out).isEmpty()
    sc = spark.sparkContext
    sc.setJobGroup("load-dataset", "read pass only")
    csvsrc.load_dataset(spark, path)
    # the scan for open quotes and one aggregate: no separate share job before the lazy clean
    assert len(list(sc.statusTracker().getJobIdsForGroup("load-dataset"))) <= 4


def test_csv_typed_read_and_load_dataset(spark, tmp_dir):
    data = b"id,dur,rate,proto,attack_cat,label\n1,1,0.5,tcp,x,0\n2,2,Infinity,udp,y,1\n3,2,Infinity,udp,y,1\n"
    path = _write(os.path.join(tmp_dir, "flows.csv"), data)
    typed = csvsrc.infer_types(csvsrc.load_csv(spark, path))
    assert dict(typed.dtypes) == {"id": "bigint", "dur": "bigint", "rate": "double", "proto": "string",
                                  "attack_cat": "string", "label": "bigint"}
    out, res = csvsrc.load_dataset(spark, path, save_processed=os.path.join(tmp_dir, "processed"))
    assert out.count() == 2 and res.format == "unknown"
    assert spark.read.parquet(os.path.join(tmp_dir, "processed")).count() == 2


def test_cleaning_is_idempotent(spark):
    rows = [("1.5", "tcp", 0), ("2", "udp", 1), ("2", "udp", 1), ("bad", "tcp", 0)] + [(str(i), "tcp", 0) for i in range(20)]
    df = spark.createDataFrame(rows, ["x", "proto", "label"])
    once, _ = cl.clean_dataframe(df)
    twice, _ = cl.clean_dataframe(once)
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)


def test_several_csv_files_read_as_one(spark, tmp_dir):
    a = _write(os.path.join(tmp_dir, "a.csv"), b"x,label\n1,0\n2,1\n")
    b = _write(os.path.join(tmp_dir, "b.csv"), b"x,label\n3,0\n")
    assert csvsrc.load_csv(spark, [a, b]).count() == 3  # S5
    assert csvsrc.load_csv(spark, os.path.join(tmp_dir, "*.csv")).count() == 3


def test_csv_quotes_and_line_breaks(spark, tmp_dir):
    path = _write(os.path.join(tmp_dir, "quoted.csv"), b'a,b,label\n"x ""y"" z","p,q",0\nu,"l1\nl2",1\n')
    rows = csvsrc.load_csv(spark, path).orderBy("label").collect()
    assert [tuple(r) for r in rows] == [('x "y" z', "p,q", "0"), ("u", "l1\nl2", "1")]


def test_csv_long_rows_raise_and_short_rows_fill(spark, tmp_dir):
    long = _write(os.path.join(tmp_dir, "long.csv"), b'a,b\n1,0\n1,,9\n"x,y",2\n')
    for typed in (False, True):
        with pytest.raises(ValueError, match="1 lines"):
            csvsrc.load_csv(spark, long, typed=typed)
    short = _write(os.path.join(tmp_dir, "short.csv"), b'a,b,c\n1,0\n2,"3,4",5\n')
    assert [tuple(r) for r in csvsrc.load_csv(spark, short).orderBy("a").collect()] == [("1", "0", None), ("2", "3,4", "5")]


def test_csv_columns_go_by_name_in_every_file(spark, tmp_dir):
    """Other orders, repeated names and columns that a file lacks; the files' numbers follow their names."""
    a = _write(os.path.join(tmp_dir, "h1.csv"), b"a,x,x,label\n1,2,3,0\n")
    b = _write(os.path.join(tmp_dir, "h2.csv"), b"label,x,x,a\n1,2,3,20\n")
    c = _write(os.path.join(tmp_dir, "h3.csv"), "\ufefflabel,extra\r\n0,\"u\r\nv\"\r\n".encode())
    _write(os.path.join(tmp_dir, "h4.csv"), b"")
    got = csvsrc.load_csv(spark, os.path.join(tmp_dir, "h*.csv"), row_id=True)
    assert got.columns == ["row_id", "a", "x", "x.1", "label", "extra"]
    assert [tuple(r) for r in got.orderBy("row_id").collect()] == [
        (0, "1", "2", "3", "0", None), (1, "20", "2", "3", "1", None), (2, None, None, None, "0", "u\r\nv"),
    ]
    # a line that is too long for its own file raises, though another file's header is longer
    _write(os.path.join(tmp_dir, "h5.csv"), b"label\n1,2\n")
    with pytest.raises(ValueError, match="more values"):
        csvsrc.load_csv(spark, os.path.join(tmp_dir, "h*.csv"))


def _random_csv(r, n):
    """Records with line breaks, quotes and commas, and what a plain parser makes of them."""
    texts = ["", "x", "a b", 'say ""hi""', "1,2", "l1\nl2", "\n", '\n""', ",\n,", '""', "5", "\n\n\nend"]
    lines, want = ["v,w,label"], []
    for i in range(n):
        v, w = r.choice(texts), r.choice(texts)
        quoted = [f'"{t}"' if any(c in t for c in ',\n"') else t for t in (v, w)]
        lines.append(f"{quoted[0]},{quoted[1]},{i}")
        want.append(tuple(t.replace('""', '"') or None for t in (v, w)) + (str(i),))
    return "\n".join(lines) + "\n", want


@pytest.mark.parametrize("size", ["128m", "64", "17"])
def test_csv_quoted_breaks_in_any_split(spark, tmp_dir, size):
    """A file cut into splits at any place (most of them inside quotes) reads as a record parser reads it whole."""
    import random

    r, want = random.Random(3), []
    for k in range(3):
        text, rows = _random_csv(r, 60)
        _write(os.path.join(tmp_dir, f"q{k}.csv"), text.encode())
        want += rows
    _write(os.path.join(tmp_dir, "q9.csv"), b"v,w,label\nplain,line,7\n")
    want.append(("plain", "line", "7"))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = csvsrc.load_csv(spark, os.path.join(tmp_dir, "q*.csv"), row_id=True).orderBy("row_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])
    assert [tuple(x)[1:] for x in got] == want and [x.row_id for x in got] == list(range(len(want)))


def test_csv_stray_quotes_do_not_join_lines(spark, tmp_dir):
    path = _write(os.path.join(tmp_dir, "stray.csv"), b'a,b,label\n5" pipe,x,0\n6" pipe,y,1\n"in ""quotes"" here",z,2\n')
    rows = csvsrc.load_csv(spark, path).orderBy("label").collect()
    assert [r.b for r in rows] == ["x", "y", "z"] and rows[0].a == '5" pipe' and rows[2].a == 'in "quotes" here'


def test_csv_open_quotes_only_slow_their_own_file(spark, tmp_dir):
    from flowlens.sources import csvfiles

    _write(os.path.join(tmp_dir, "p.csv"), b'a,label\n"x ""q""",0\n')
    _write(os.path.join(tmp_dir, "o.csv"), b'a,label\n"x\ny",0\n')
    files = csvfiles.data_files(spark, [tmp_dir])
    assert {os.path.basename(f) for f in csvfiles.files_with_open_lines(spark, files, "utf-8")} == {"o.csv"}
    latin = _write(os.path.join(tmp_dir, "l.csv"), 'a,label\n"é\nÿ",0\n'.encode("latin-1"))
    assert csvsrc.load_csv(spark, latin).first().a == "é\nÿ"


def test_csv_repeated_header_names(spark, tmp_dir):
    path = _write(os.path.join(tmp_dir, "rep.csv"), b"len,x1,len,label,len\n1,2,3,0,5\n")
    out = csvsrc.load_csv(spark, path)
    assert out.columns == ["len", "x1", "len.1", "label", "len.2"]
    assert tuple(out.first()) == ("1", "2", "3", "0", "5")
    plain = _write(os.path.join(tmp_dir, "plain.csv"), b"c0,c1\n1,2\n")
    assert csvsrc.load_csv(spark, plain).columns == ["c0", "c1"]


def test_csv_truth_words_are_booleans(spark, tmp_dir):
    path = _write(os.path.join(tmp_dir, "bool.csv"), b"f,g,label\nTrue,true,0\nFalse,,1\n")
    assert dict(csvsrc.load_csv(spark, path, typed=True).dtypes) == {"f": "boolean", "g": "string", "label": "bigint"}
