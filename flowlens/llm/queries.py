"""Registered queries of the operators (production parameters, whole tables) and the SQL where SQL can express them."""

from __future__ import annotations

from hashlib import sha256
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import bpe, crf, crosstoken, linededup, minhash, mixing, pieces, pivots, pstable, pulearn, sharding, warc, wordruns
from flowlens.llm.common import shipped, table


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.convert_pages(table(spark, sf_dir, "pages"))


def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pulearn.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pstable_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pstable.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_products(table(spark, sf_dir, "embeddings"))


def op7_kk_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op9_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"), linededup.WORD_EDITS).drop("rest")


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words whose runs are asked for: a tenth of the documents, by the crc32 of their id, end in a periodic tail."""
    if doc_id is None or not words or (h := crc32(str(doc_id).encode())) % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + period]
    return words[:a] + (tail * (-(-(n - a) // period)))[: n - a]


def op11_automaton_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wordruns.periodic_runs(table(spark, sf_dir, "documents"), periodic_tail)
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    # longest; of equals the smallest start, then the smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )  # fmt: skip


def op12_piece_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_documents(table(spark, sf_dir, "documents"), with_text=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )  # fmt: skip


def op13_fragment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda groups: sha256(groups.encode()).hexdigest() if groups else ""  # noqa: E731
    counted = crosstoken.count_links(table(spark, sf_dir, "documents"), digest)
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


QUERIES = {
    f.__name__: shipped(f)
    for f in (
        op1_arc_to_warc, op2_pu_quality, op3_crf_toxicity, op4_pstable_vectors, op5_minhash, op6_pivot_topk, op7_kk_shards,
        op8_tree_bpe, op9_water_filling, op10_line_edit_join, op11_automaton_runs, op12_piece_rounds, op13_fragment_alignment,
    )
}  # fmt: skip

WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT"

# smallest reachable name of each node: ``nodes`` (n) and ``edges`` (a, b, both ways)
REACHED = """
reached AS (SELECT n, n AS c FROM nodes UNION SELECT e.b, r.c FROM reached r JOIN edges e ON r.n = e.a),
least AS (SELECT n, min(c) AS c FROM reached GROUP BY n)"""

ORACLE_SQL = {
    "op4_pstable_vectors": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings
  WHERE len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {pstable.THRESHOLD}
), edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), nodes AS (SELECT vec_id AS n FROM embeddings),{REACHED}
SELECT vec_id, (SELECT count(*) FROM edges WHERE a = vec_id)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN least ON n = vec_id""",
    "op5_minhash": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+'), []) AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) >= {minhash.WIDTH} THEN list_distinct([array_to_string(ws[i : i + {minhash.WIDTH - 1}], ' ') FOR i IN range(1, len(ws) - {minhash.WIDTH - 2})])
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w
), u AS (SELECT doc_id, unnest(sh) AS x FROM s
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), linked AS (
  SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
  WHERE 100 * n >= {minhash.THRESHOLD} * (len(x.sh) + len(y.sh) - n)
), edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked
), nodes AS (SELECT doc_id AS n FROM documents),{REACHED}
SELECT doc_id, len(sh)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM s JOIN least ON n = doc_id""",
    "op1_arc_to_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), g AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM g""",
    "op6_pivot_topk": """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op9_water_filling": f"""
WITH d AS (
  SELECT doc_id, source, {WORDS} AS size,
         md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS draw
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS n, (((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1)::BIGINT AS w
  FROM d GROUP BY source
), t AS (SELECT sum(n) AS total FROM s
), levels AS (
  -- the water level if all sources with a smaller cap for each unit of weight are clamped
  SELECT a.source, a.n * 3 AS cap, a.w,
         (SELECT total FROM t) - coalesce(sum(b.n * 3) FILTER (WHERE b.n * a.w < a.n * b.w), 0) AS rest,
         sum(b.w) FILTER (WHERE b.n * a.w >= a.n * b.w) AS weights
  FROM s a CROSS JOIN s b GROUP BY a.source, a.n, a.w
), level AS (
  SELECT rest, weights FROM levels WHERE rest * w <= cap * weights ORDER BY cap * 1.0 / w LIMIT 1
), targets AS (
  SELECT s.source, s.n,
         CASE WHEN w * rest > 3 * n * weights THEN (3 * n)::DOUBLE ELSE w * rest::DOUBLE / weights::DOUBLE END AS target
  FROM s CROSS JOIN level
), c AS (
  SELECT d.*, t.n, t.target, CASE WHEN t.n > 0 THEN floor(t.target / t.n)::BIGINT ELSE 0 END AS whole,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.size RANGE UNBOUNDED PRECEDING) AS after
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, n AS source_size, target,
       (size * (whole + CASE WHEN after - size / 2.0 <= target - whole * n THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c""",
}
