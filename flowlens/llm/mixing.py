"""Mixing sources to target weights by capped water-filling; DataFrame functions only, no Python on the executors.

Sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ...; together they share all words.  A source's target
stops at EPOCHS times its own words; what that leaves over is shared among the others by weight, again and again until
none is above.  A source then takes floor(target / size) whole repetitions of every document, and one more of those
documents that come first in a seeded order, up to the rest of its target.

The seeded order is that of md5(seed : doc_id).  Sums over the hash ranges of each source (partial sums before the
shuffle) find the range where the rest of the target ends; that range is cut again by the next digits until it holds at
most ``TORN_ROWS`` rows, and only those are ordered one by one.  So a source with a third of all rows never meets in one task.
Sources are numbered by ranges of their names, a task each; the water level leaves Spark as four sums.

Defined cases: a null or blank text has size 0 and is taken 0 words; it has no more copies than any document of its
source, EPOCHS at most; a null source is a source of its own; of repeated
rows (same doc_id, source and size) the order breaks no tie, so they are taken together or not at all where the range
ends between them; an empty table gives no rows; if all sizes are 0, all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import written

EPOCHS = 3
WEIGHTS = 3  # 1, 2, 3, repeating
SEED = 20240607
WORD = r"[^\x20\x09-\x0D]+"
RANGE_DIGITS = 3  # 16**3 hash ranges for each source, and as many inside the range that is torn
DRAW_DIGITS = 32
TORN_ROWS = 1 << 16
SALTS = 32


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, weight) with ``target``: clamp the sources above their cap until none is, share the rest."""
    cap = F.col("source_size") * F.lit(epochs)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    clamped, was = F.lit(False), -1
    while True:
        done, held, weights = sources.agg(
            F.sum(F.when(clamped, 1).otherwise(0)),
            F.sum(F.when(clamped, cap).otherwise(0).cast("decimal(38,0)")),
            F.sum(F.when(clamped, 0).otherwise(F.col("weight")).cast("decimal(38,0)")),
        ).first()
        left, weights = int(total) - int(held or 0), int(weights or 0)
        if done == was or not weights:
            break
        was = done
        wide = lambda n: F.lit(n).cast("decimal(30,0)")
        # weight x left / weights > cap, in whole numbers
        clamped = clamped | (F.col("weight").cast("decimal(8,0)") * wide(left) > cap.cast("decimal(28,0)") * F.lit(weights).cast("decimal(10,0)"))
    share = F.col("weight") * F.lit(float(left)) / F.lit(float(weights or 1))
    return sources.withColumn("target", F.when(clamped, cap.cast("double")).otherwise(share))


def numbered(sources: DataFrame) -> DataFrame:
    """``weight`` of each source by its place in code-point order, null last: ranges of sources, numbered a task each."""
    named = sources.where("source is not null").repartitionByRange("source").withColumn("part", F.spark_partition_id())
    named = written(named, "mix-sources")
    sizes = named.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    place = F.row_number().over(Window.partitionBy("part").orderBy("source")) - 1
    named = named.join(sizes.select("part", before.alias("before")), "part").select("source", "source_size", (F.col("before") + place).alias("place"))
    last = sources.where("source is null").select("source", "source_size", F.lit(named.count()).cast("long").alias("place"))
    return written(named.union(last).withColumn("weight", (F.col("place") % WEIGHTS + 1).cast("long")).drop("place"), "mix-weights")


def torn_ranges(ranges: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with the first range of each source that its rest does not cover (``torn``, null: all are covered), the
    words below it (``start``) and its rows."""
    up_to = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = ranges.withColumn("upto", F.sum("words").over(up_to)).join(targets, F.col("source").eqNullSafe(F.col("s")))
    over = edges.where(F.col("start") + F.col("upto") > F.col("rest"))
    first = F.min_by(F.struct("range", (F.col("start") + F.col("upto") - F.col("words")).alias("start"), "rows"), "range")
    over = over.groupBy("source").agg(first.alias("t"))
    kept = targets.drop("start").join(over, F.col("source").eqNullSafe(F.col("s")), "left")
    return kept.select(*[c for c in targets.columns if c != "start"], F.col("t.range").alias("torn"), F.coalesce("t.start", F.lit(0)).alias("start"), F.coalesce("t.rows", F.lit(0)).alias("rows"))


def by_source(sized: DataFrame, of_source: DataFrame) -> DataFrame:
    """Rows with what a table holds for their source ``s``; a source's rows meet ``SALTS`` copies of it in as many places."""
    salt = F.pmod(F.xxhash64("draw", "size"), F.lit(SALTS)).cast("int")
    copies = of_source.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return sized.join(copies, F.col("source").eqNullSafe(F.col("s")) & (salt == F.col("salt"))).drop("s", "salt")


def mix(docs: DataFrame, epochs: int = EPOCHS, seed: int = SEED, torn_rows: int = TORN_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (how often the mix takes the document)."""
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("size"),
    )
    sized = sized.withColumn("draw", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    sized = written(sized.withColumn("range", F.substring("draw", 1, RANGE_DIGITS)), "mix-sizes")

    # rows of one doc_id share their draw and need no cutting
    distinct_rows = F.when(F.min("draw") == F.max("draw"), 1).otherwise(F.count(F.lit(1))).cast("long").alias("rows")
    ranges = written(sized.groupBy("source", "range").agg(F.sum("size").alias("words"), distinct_rows), "mix-ranges")
    sources = ranges.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(numbered(sources), epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = targets.select(F.col("source").alias("s"), "source_size", "target", "whole", "rest")
    targets = written(targets.withColumn("start", F.lit(0).cast("long")), "mix-targets")

    digits = RANGE_DIGITS
    torn = written(torn_ranges(ranges, targets), "mix-torn")
    while digits < DRAW_DIGITS and (torn.agg(F.max("rows")).first()[0] or 0) > torn_rows:
        digits += RANGE_DIGITS
        inside = by_source(sized, torn.select("s", F.col("torn").alias("within"), F.length("torn").alias("n")))
        inside = inside.where(F.expr("substring(draw, 1, n)") == F.col("within"))
        inside = inside.groupBy("source", F.substring("draw", 1, digits).alias("range")).agg(F.sum("size").alias("words"), distinct_rows)
        torn = written(torn_ranges(inside, torn.drop("torn", "rows")), "mix-torn")

    rows = by_source(sized.drop("range"), torn.drop("rows"))
    mine = F.expr("substring(draw, 1, length(torn))")
    before = F.coalesce(mine < F.col("torn"), F.lit(True)) & (F.col("rest") > 0)  # no range is torn: all are in
    columns = ["doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("extra")).alias("copies")]
    inside = (mine == F.col("torn")) & (F.col("rest") > 0)
    clear = rows.where(~F.coalesce(inside, F.lit(False))).withColumn("extra", before.cast("long"))
    # a document is taken when no more than half of it lies above the end of the rest; rows of one draw and size go together
    edge = rows.where(inside)
    steps = edge.groupBy("source", "draw", "size", "start", "rest").agg(F.sum("size").alias("words"))
    within = Window.partitionBy("source").orderBy("draw", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumn("extra", (F.col("start") + F.sum("words").over(within) - F.col("size") / F.lit(2) <= F.col("rest")).cast("long"))
    steps = steps.select(F.col("source").alias("s"), F.col("draw").alias("w"), F.col("size").alias("z"), "extra")
    edge = edge.join(steps, F.col("source").eqNullSafe(F.col("s")) & (F.col("draw") == F.col("w")) & (F.col("size") == F.col("z")))
    return clear.select(*columns).union(edge.select(*columns))


def mixed_rows(docs: DataFrame, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs``, each repeated as often as it is taken, columns unchanged.

    Rows that share doc_id and source must agree in size; they are drawn together.
    """
    taken = mix(docs, epochs, seed).select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), "copies")
    taken = taken.groupBy("_d", "_s", "_z").agg(F.max("copies").alias("_copies"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), word_count(F.col("text").cast("string")).alias("words"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("_d")) & F.col("row.source").cast("string").eqNullSafe(F.col("_s"))
    rows = rows.join(taken, same & (F.col("words") == F.col("_z"))).where("_copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("row.*")
