"""CSV files in parallel: each file's own header, and records whose quoted values hold line breaks.

* Headers: the first record of every file is read (some bytes of each, a thread pool on the driver).  Files with the same
  header form one reader; the readers' tables are put together by column name, so that files may order their columns in
  any way, repeat names, or lack some of them (missing values).
* Quoted line breaks: a file is cut at line ends into splits that different tasks read, so a task cannot know whether its
  first line lies inside quotes.  What a line does is one of four functions of the state it begins in (in or out of
  quotes).  If no line opens quotes that it does not close, every state is "out" and the plain reader is exact; one scan of
  the raw lines finds the files where that is not so.  For these, the functions of a split's lines are composed by windows
  inside the split, those of a file's splits by a window over one row a split; that gives every line's state, and lines that
  belong to one record are put together.  All records are then parsed by ``from_csv``.  Each task holds one split, and one
  record's lines; an unclosed quote makes the rest of its file one record, as with any reader.
"""

from __future__ import annotations

import csv
import io
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.session import stored

MALFORMED = "_malformed_line"
PLACE = ["_csv_file", "_csv_block", "_csv_place"]  # where a row stands: file, start of its split, place in the task
HEADER_THREADS = 16
HEADER_BYTES = 1 << 16
_OPTIONS = {"mode": "PERMISSIVE", "escape": '"', "columnNameOfCorruptRecord": MALFORMED}


# --- headers ------------------------------------------------------------------------------


def data_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files below the paths, in path order."""
    jvm = spark._jvm
    found = spark.read.text(paths).inputFiles()
    return sorted(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).toString() for f in found)


def _first_record(spark: SparkSession, file: str) -> bytes:
    """The bytes of a file's first record (a line end inside quotes does not end it); none of an empty file."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(conf).open(path)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
    if codec is not None:
        stream = codec.createInputStream(stream)
    try:
        data = b""
        while True:
            more = bytes(stream.readNBytes(HEADER_BYTES))
            data += more
            end = data.find(b"\n")
            while end >= 0 and data.count(b'"', 0, end) % 2:
                end = data.find(b"\n", end + 1)
            if end >= 0:
                return data[:end]
            if len(more) < HEADER_BYTES:
                return data
    finally:
        stream.close()


def header_names(record: bytes, encoding: str) -> tuple[str, ...]:
    text = record.decode(encoding, "replace").lstrip("﻿").rstrip("\r\n")
    return tuple(next(csv.reader(io.StringIO(text, newline="")), ()))


def headers(spark: SparkSession, files: list[str], encoding: str) -> dict[str, tuple[str, ...]]:
    """Each file's column names; files without a byte are left out."""
    with ThreadPoolExecutor(HEADER_THREADS) as pool:
        records = list(pool.map(lambda f: _first_record(spark, f), files))
    return {f: header_names(r, encoding) for f, r in zip(files, records) if r.strip()}


def unique_names(names: list[str]) -> list[str]:
    """Repeated header names get ``.1``, ``.2`` ...; Spark ignores case in names, so this does too."""
    taken = {n.lower() for n in names}
    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(names):
        n = n or f"_c{i}"
        k = seen.get(n.lower(), 0)
        seen[n.lower()] = k + 1
        new = n
        while k and new.lower() in taken:
            new = f"{n}.{k}"
            k += 1
        taken.add(new.lower())
        out.append(new)
    return out


# --- quotes across lines -------------------------------------------------------------------


def _state_after(line, start: str):
    """Whether a line ends inside quotes, if it begins outside at a field's start ("F") or inside ("Q").

    States: F at a field's start, T in plain text, Q in quotes, C behind a quote that closes unless another follows.  The
    texts between the quotes are taken one by one; each quote and then each text moves the state."""

    def text(state, part):
        after = F.when(part.endswith(","), F.lit("F")).otherwise(F.lit("T"))
        return F.when((part == "") | (state == "Q"), state).otherwise(after)

    def quote(state):
        return F.when(state.isin("F", "C"), F.lit("Q")).when(state == "Q", F.lit("C")).otherwise(state)

    parts = F.split(line, '"', -1)
    rest = F.slice(parts, F.lit(2), F.size(parts))
    return F.aggregate(rest, text(F.lit(start), F.element_at(parts, 1)), lambda s, part: text(quote(s), part)) == "Q"


def raw_lines(spark: SparkSession, files: list[str], encoding: str) -> DataFrame:
    """``line`` and where it stands; only line feeds end a line."""
    rows = spark.read.option("lineSep", "\n").text(files)
    line = F.col("value") if encoding.lower().replace("-", "") == "utf8" else F.decode(F.col("value").cast("binary"), encoding)
    return rows.select(
        line.alias("line"), F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.file_block_start").alias(PLACE[1]),
        F.monotonically_increasing_id().alias(PLACE[2]),
    )


def files_with_open_lines(spark: SparkSession, files: list[str], encoding: str) -> set[str]:
    """Files in which some line opens quotes and does not close them: one scan, a set of file names comes back."""
    lines = raw_lines(spark, files, encoding)
    opening = lines.where(F.contains("line", F.lit('"')) & _state_after(F.col("line"), "F"))
    found = opening.agg(F.collect_set(PLACE[0])).first()[0]
    jvm = spark._jvm
    return {jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).toString() for f in found}


def records(lines: DataFrame) -> DataFrame:
    """The records of raw lines: ``line`` (with its inner line ends), where it stands, and ``first`` for each file's first."""
    file, block, place = PLACE
    from_out = F.when(F.contains("line", F.lit('"')), _state_after(F.col("line"), "F")).otherwise(F.lit(False))
    from_in = F.when(F.contains("line", F.lit('"')), _state_after(F.col("line"), "Q")).otherwise(F.lit(True))
    x = lines.withColumn("out_to", from_out).withColumn("in_to", from_in)
    # what a line leaves whatever it began with (else null), and whether it swaps the states
    x = x.withColumn("fixed", F.when(F.col("out_to") == F.col("in_to"), F.col("out_to")))
    x = x.withColumn("swap", (F.col("out_to") & ~F.col("in_to")).cast("int"))
    order = Window.partitionBy(file, block).orderBy(place)
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("swaps", F.coalesce(F.sum("swap").over(before), F.lit(0)))
    known = F.when(F.col("fixed").isNotNull(), F.struct("fixed", (F.col("swaps") + F.col("swap")).alias("at")))
    x = x.withColumn("known", F.last(known, ignorenulls=True).over(before)).withColumn("upto", F.last(known, ignorenulls=True).over(upto))

    def state(start: bool, last, swaps):
        """In quotes?  From the last line that fixed the state and the swaps since, or from the split's start."""
        odd = lambda n: (n % 2) == 1
        since = odd(swaps - last["at"])
        return F.when(last.isNotNull(), last["fixed"] != since).otherwise(odd(swaps) if not start else ~odd(swaps))

    for name, start in (("0", False), ("1", True)):
        x = x.withColumn(f"in{name}", state(start, F.col("known"), F.col("swaps")))
        begins = F.when(~F.col(f"in{name}"), F.struct(block, place))
        x = x.withColumn(f"rec{name}", F.last(begins, ignorenulls=True).over(upto))
        x = x.withColumn(f"end{name}", state(start, F.col("upto"), F.col("swaps") + F.col("swap")))
    keep = ["line", *PLACE, "out_to", "in0", "in1", "rec0", "rec1", "end0", "end1"]
    x = stored(x.select(*keep), "csv-lines")

    # a split is a line of the same four kinds; so is the file's prefix
    last = F.max_by(F.struct("end0", "end1", "rec0", "rec1"), place)
    splits = x.groupBy(file, block).agg(last.alias("last"), F.min(place).alias("head"))
    by_file = Window.partitionBy(file).orderBy(block)
    earlier, so_far = by_file.rowsBetween(Window.unboundedPreceding, -1), by_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    splits = splits.withColumn("fixed", F.when(F.col("last.end0") == F.col("last.end1"), F.col("last.end0")))
    splits = splits.withColumn("swap", (F.col("last.end0") & ~F.col("last.end1")).cast("int"))
    splits = splits.withColumn("swaps", F.coalesce(F.sum("swap").over(earlier), F.lit(0)))
    known = F.when(F.col("fixed").isNotNull(), F.struct("fixed", (F.col("swaps") + F.col("swap")).alias("at")))
    splits = splits.withColumn("known", F.last(known, ignorenulls=True).over(earlier))
    splits = splits.withColumn("inside", state(False, F.col("known"), F.col("swaps")))
    begun = F.when(F.col("inside"), F.col("last.rec1")).otherwise(F.col("last.rec0"))
    splits = splits.withColumn("begun", F.last(begun, ignorenulls=True).over(earlier))
    top = F.first(F.struct(block, F.col("head").alias(place))).over(so_far)
    splits = splits.select(F.col(file).alias("f"), F.col(block).alias("b"), "inside", "begun", top.alias("top"))

    # one row a split and no text: broadcast, so that the lines are not shuffled to meet it
    x = x.join(F.broadcast(splits), (F.col(file) == F.col("f")) & (F.col(block) == F.col("b")))
    pick = lambda name: F.when(F.col("inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    x = x.select("line", *PLACE, "out_to", "top", pick("in").alias("in"), F.coalesce(pick("rec"), F.col("begun")).alias("rec"))
    first = (F.col("rec") == F.col("top")).alias("first")
    alone = x.where(~F.col("in") & ~F.col("out_to")).select("line", *PLACE, first)
    parts = x.where(F.col("in") | F.col("out_to")).withColumn("first", first)
    texts = F.transform(F.sort_array(F.collect_list(F.struct(block, place, "line"))), lambda p: p["line"])
    joined = parts.groupBy(file, "rec").agg(F.array_join(texts, "\n").alias("line"), F.max("first").alias("first"))
    joined = joined.select("line", file, F.col(f"rec.{block}").alias(block), F.col(f"rec.{place}").alias(place), "first")
    return alone.union(joined)


# --- reading -------------------------------------------------------------------------------


def _strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in [*names, MALFORMED]])


def _parsed(spark: SparkSession, files: list[str], names: list[str], encoding: str) -> DataFrame:
    """Files with line breaks in quotes: their records through ``from_csv``."""
    found = records(raw_lines(spark, files, encoding)).where("not first")
    line = F.regexp_replace("line", "\r$", "")
    # stored once: the checks and the caller both read them
    found = stored(found.select(line.alias("line"), *PLACE).where("line <> ''"), "csv-records")
    schema = ", ".join(f"`{f.name.replace('`', '``')}` STRING" for f in _strings(names).fields)
    return found.select(F.from_csv("line", schema, {k: v for k, v in _OPTIONS.items()}).alias("row"), *PLACE).select("row.*", *PLACE)


def _plain(spark: SparkSession, files: list[str], names: list[str], encoding: str) -> DataFrame:
    """Files whose lines are records.  The headers were compared by :func:`headers`, so values go by position."""
    rows = spark.read.options(header=True, enforceSchema=True, encoding=encoding, **_OPTIONS).schema(_strings(names)).csv(files)
    data = [F.col("`" + c.replace("`", "``") + "`") for c in rows.columns]
    place = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    return rows.select(*data, *[p.alias(n) for p, n in zip(place, PLACE)])


@dataclass
class Part:
    """The table of files that share a header: their names' text columns, the malformed line and where each row stands."""

    table: DataFrame
    names: list[str]
    raw: tuple[str, ...]


def read_parts(spark: SparkSession, files: list[str], encoding: str, quoted_breaks: bool) -> list[Part]:
    """One table for each distinct header, in the order of the files."""
    named = headers(spark, files, encoding)
    careful = files_with_open_lines(spark, list(named), encoding) if quoted_breaks and named else set()
    groups: dict[tuple[str, ...], list[str]] = {}
    for f in files:
        if f in named:
            groups.setdefault(named[f], []).append(f)
    out = []
    for raw, members in groups.items():
        names = unique_names(list(raw))
        easy, hard = [f for f in members if f not in careful], [f for f in members if f in careful]
        tables = ([_plain(spark, easy, names, encoding)] if easy else []) + ([_parsed(spark, hard, names, encoding)] if hard else [])
        table = tables[0] if len(tables) == 1 else tables[0].union(tables[1])
        out.append(Part(table, names, raw))
    return out
