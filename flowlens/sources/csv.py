"""CSV flow-table source (S1-S3, S5) and the processed-data loader.

Files are read as strings in parallel splits (no schema inference pass), each by its own header and with line breaks in
quotes (:mod:`flowlens.sources.csvfiles`); typing is decided later by the cleaning chain's numeric-share job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.constants import COLUMNS_TO_DROP, NA_TOKENS, NUMERIC_SHARE_THRESHOLD, ROW_ID, TARGET
from flowlens.functions.numeric import NUMERIC_PATTERN
from flowlens.operators.clean import (
    CleanResult,
    clean_dataframe,
    col,
    normalized_names,
    numeric_candidates,
    resolve_target,
)
from flowlens.operators.ranking import starts
from flowlens.session import stored
from flowlens.sources.csvfiles import MALFORMED, PLACE, Part, data_files, read_parts

# fixed value: an integer literal as a CSV reader types it
INTEGER_PATTERN = r"^\s*[+-]?[0-9]+\s*$"

# fixed values: the words a CSV reader types as booleans
BOOLEAN_WORDS = ("True", "TRUE", "true", "False", "FALSE", "false")

REPLACEMENT_CHAR = "�"


def _expand(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """The paths with patterns resolved by the file system that holds them (local, HDFS or object store)."""
    items = [paths] if isinstance(paths, str) else list(paths)
    out: list[str] = []
    conf = spark._jsc.hadoopConfiguration()
    for p in items:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        hits = path.getFileSystem(conf).globStatus(path)
        if not hits:
            raise FileNotFoundError(f"no such CSV input: {p}")
        out.extend(h.getPath().toString() for h in hits)
    return out


@dataclass
class _Csv:
    """What a read knows before its rows are checked: a table for each distinct header."""

    parts: list[Part]

    @property
    def headers(self) -> list[str]:
        return [n for p in self.parts for n in p.raw]

    def table(self, place: bool = False) -> DataFrame:
        """All parts put together by name, with ``MALFORMED`` last but for where each row stands (if asked for)."""
        out = None
        for p in self.parts:
            one = p.table if place else p.table.drop(*PLACE)
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        last = [c for c in out.columns if c in (MALFORMED, *PLACE)]
        return out.select(*[col(c) for c in out.columns if c not in last], *last)

    def checks(self, counts) -> DataFrame:
        """The table with ``_long`` and ``_bad`` flags of each row, which a part judges by its own header."""
        out = None
        for p in self.parts:
            one = p.table.drop(*PLACE)
            one = one.withColumn("_long", _too_long(one)).withColumn("_bad", _bad_bytes(one)).drop(MALFORMED)
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return na_tokens(out).agg(F.count(F.lit(1)).alias("_n"), F.max(F.col("_bad").cast("int")).alias("_bad"), F.count_if("_long").alias("_long"), *counts)


def _read(spark: SparkSession, paths: list[str], encoding: str, quoted_breaks: bool = True) -> _Csv:
    parts = read_parts(spark, data_files(spark, paths), encoding, quoted_breaks)
    if not parts:
        raise ValueError(f"no header line in {paths}")
    return _Csv(parts)


def _values(df: DataFrame) -> DataFrame:
    return df.drop(MALFORMED)


def _too_long(df: DataFrame):
    """True for a line with more values than the header has names (a shorter one is filled with NULL)."""
    commas = F.length(F.regexp_replace(col(MALFORMED), '(?s)"[^"]*"|[^,]', ""))
    return F.coalesce(commas >= len(df.columns) - 1, F.lit(False))


def _bad_bytes(df: DataFrame):
    """True for a row where some value holds U+FFFD (bytes that were not UTF-8)."""
    bad = None
    for c in _values(df).columns:
        hit = F.coalesce(col(c).contains(REPLACEMENT_CHAR), F.lit(False))
        bad = hit if bad is None else (bad | hit)
    return bad


def _undecoded_header(read: _Csv) -> bool:
    return any(REPLACEMENT_CHAR in n for n in read.headers)


def na_tokens(df: DataFrame, tokens=NA_TOKENS) -> DataFrame:
    """S3: the default missing-value tokens of a CSV read become NULL (string columns)."""
    toks = list(tokens)
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if f.dataType.typeName() == "string":
            out.append(F.when(c.isin(toks), F.lit(None).cast("string")).otherwise(c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def _type_counts(strings: list[str]) -> list:
    aggs = []
    for i, c in enumerate(strings):
        v = col(c)
        aggs += [
            F.count(v).alias(f"p{i}"),
            F.count(F.when(v.rlike(INTEGER_PATTERN) & v.try_cast("long").isNotNull(), 1)).alias(f"i{i}"),
            F.count(F.when(v.rlike(NUMERIC_PATTERN), 1)).alias(f"d{i}"),
            F.count_if(~F.coalesce(v.isin(*BOOLEAN_WORDS), F.lit(False))).alias(f"b{i}"),
        ]
    return aggs


def infer_types(df: DataFrame, row=None) -> DataFrame:
    """Read-time typing of string columns, as a CSV reader infers it.

    A column whose every value is a truth word becomes BOOLEAN; one
    whose every present value is an integer becomes BIGINT; one
    whose every present value is a number (infinity included) becomes
    DOUBLE; an all-missing column becomes DOUBLE; anything else stays a
    string for the 90 % rule of the cleaning chain.  One aggregate job
    (``row``: its result, already computed together with another check).
    """
    strings = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    if not strings:
        return df
    if row is None:
        row = df.agg(*_type_counts(strings)).first()
    kinds = {}
    for i, c in enumerate(strings):
        present, ints, nums = row[f"p{i}"], row[f"i{i}"], row[f"d{i}"]
        if present == 0:
            kinds[c] = "double"
        elif row[f"b{i}"] == 0:
            kinds[c] = "boolean"
        elif ints == present:
            kinds[c] = "long"
        elif nums == present:
            kinds[c] = "double"
    return df.select(*[col(c).try_cast(kinds[c]).alias(c) if c in kinds else col(c) for c in df.columns])


def load_csv(
    spark: SparkSession,
    source: str | list[str],
    encoding: str = "utf-8",
    detect_encoding: bool = True,
    typed: bool = False,
    quoted_breaks: bool = True,
    row_id: bool = False,
) -> DataFrame:
    """S1 + S2 + S3 + S5: read one or many CSV files with a header row, as strings.

    Missing path -> ``FileNotFoundError``; no file with a header (zero
    bytes) or a line with more values than its file's header -> an error.
    Files may have different headers: columns go by name, and a column that
    a file lacks is missing in its rows.  When UTF-8 decoding produced U+FFFD
    the files are re-read as latin-1 (ISO-8859-1), which decodes any byte.
    Quoted values may hold line breaks, at the price of one scan of the raw
    lines that looks for them; ``quoted_breaks=False`` saves it where the
    caller knows that there are none.  ``row_id`` numbers the rows by file and
    line in a first column ``row_id``.
    """
    paths = _expand(spark, source)
    read, row = _checked(spark, paths, encoding, detect_encoding, quoted_breaks, typed)
    table = read.table(place=row_id)
    if row_id:
        table = stored(table, "csv-rows")
        sizes = table.groupBy(*PLACE[:2]).agg(F.count(F.lit(1)).alias("n"))
        # by rank, not by difference: where records were put together, places have gaps
        rank = F.row_number().over(Window.partitionBy(*PLACE[:2]).orderBy(PLACE[2])) - 1
        table = table.withColumn("_csv_rank", rank).join(starts(sizes, PLACE[:2]).withColumnRenamed("start", "_csv_start"), PLACE[:2])
        table = table.withColumn(ROW_ID, (F.col("_csv_start") + F.col("_csv_rank")).cast("long")).drop(*PLACE, "_csv_rank", "_csv_start")
        table = table.select(ROW_ID, *[col(c) for c in table.columns if c != ROW_ID])
    out = na_tokens(_values(table))
    return infer_types(out, row) if typed else out


def _checks_encoding(encoding: str, detect_encoding: bool) -> bool:
    return detect_encoding and encoding.lower().replace("-", "") in ("utf8",)


def _checked(spark: SparkSession, paths: list[str], encoding: str, detect_encoding: bool, quoted_breaks: bool, typed: bool):
    """A read whose lines have been checked, in one aggregate: undecodable values, lines that are too long and, if the
    columns are to be typed, their type counts.  Undecodable bytes mean a latin-1 re-read and a second pass (rare)."""
    read = _read(spark, paths, encoding, quoted_breaks)
    check = _checks_encoding(encoding, detect_encoding)
    if check and _undecoded_header(read):
        read, check = _read(spark, paths, "ISO-8859-1", quoted_breaks), False
    for attempt in (0, 1):
        row = read.checks(_type_counts(_values(read.table()).columns) if typed else []).first()
        if row["_long"]:
            raise ValueError(f"{row['_long']} lines of {paths} hold more values than the header has names")
        if not (check and row["_bad"] and attempt == 0):
            break
        read = _read(spark, paths, "ISO-8859-1", quoted_breaks)
    return read, row


def _load_typed(spark: SparkSession, paths: list[str]):
    """Typed read in one aggregate pass; returns (typed frame, numeric shares).

    The pass answers three questions at once: any undecodable value (U+FFFD
    is no NA token, so checking after ``na_tokens`` is the same), the
    read-time type counts, and, per column left as text, the share of ALL
    rows that parse as a number -- the cleaning chain's 90 % rule needs no
    pass of its own.
    """
    read, row = _checked(spark, paths, "utf-8", True, True, True)
    nt = na_tokens(_values(read.table()))
    typed_df = infer_types(nt, row)
    still_text = {f.name for f in typed_df.schema.fields if f.dataType.typeName() == "string"}
    n = row["_n"] or 0
    shares = {c: (row[f"d{i}"] / n if n else 0.0) for i, c in enumerate(nt.columns) if c in still_text}
    return typed_df, shares


def _columns_to_coerce(raw: DataFrame, shares: dict[str, float], target: str = TARGET) -> list[str]:
    """The cleaning chain's C5 decision from shares measured at read time.

    Same candidates as the chain (text columns after name normalisation and
    target resolution, neither the target nor the row id), same threshold.
    """
    names, _ = normalized_names(raw.columns)
    by_name = {new: shares[old] for old, new in zip(raw.columns, names) if old in shares}
    resolved = resolve_target(raw.toDF(*names), target)  # metadata only; raises like the chain
    renamed = [n for n, r in zip(names, resolved.columns) if n != r]
    text = set(numeric_candidates(resolved, target))
    return [
        n for n in names
        if n not in renamed and n not in COLUMNS_TO_DROP and n in text
        and by_name.get(n, 0.0) >= NUMERIC_SHARE_THRESHOLD
    ]


def load_dataset(
    spark: SparkSession,
    source: str | list[str] | DataFrame,
    save_processed: str | None = None,
    fmt: str = "parquet",
) -> tuple[DataFrame, CleanResult]:
    """Load + clean, optionally persisting the processed table."""
    if isinstance(source, DataFrame):
        cleaned, result = clean_dataframe(source)
    else:
        raw, shares = _load_typed(spark, _expand(spark, source))
        cleaned, result = clean_dataframe(raw, coerce_columns=_columns_to_coerce(raw, shares))
    if save_processed:
        writer = cleaned.write.mode("overwrite")
        if fmt == "csv":
            writer.option("header", True).csv(save_processed)
        else:
            writer.parquet(save_processed)
    return cleaned, result
