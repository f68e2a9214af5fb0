"""The operators of this folder bound to the driver tables, and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, embeddings, exact, jaccard, licenses, mixing, packing, pieces, runs, sharding, suffixes, tokens, toxicity, whitening


def oracles() -> dict[str, str]:
    return {**ORACLES, "op5_license_scan": licenses.scan_sql()}


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


EXACT_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents
), w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""


@query("op8_exact_dedup", EXACT_SQL)
def op8(spark, sf_dir):
    found = exact.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


JACCARD_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.v FROM reach r JOIN links l ON r.b = l.u
)
SELECT d.doc_id, coalesce(any_value(z.n), 0) AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
"""


@query("op9_jaccard_join", JACCARD_SQL)
def op9(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op10_sharding")
def op10(spark, sf_dir):
    rows = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 40)
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op1_token_counts")
def op1(spark, sf_dir):
    return tokens.length_histogram(tokens.token_counts(table(spark, sf_dir, "documents")))


@query("op3_packing")
def op3(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


COSINE_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.v FROM reach r JOIN links l ON r.b = l.u
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.u = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON a = e.vec_id
"""


@query("op6_embedding_dedup", COSINE_SQL)
def op6(spark, sf_dir):
    return embeddings.embedding_components(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query("op7_toxicity")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")


PASSAGES_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i - 1 AS start, array_to_string(w[i:i + 49], ' ') AS words FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)
), repeated AS (
  SELECT doc_id, start, first_value(doc_id) OVER e AS from_id, first_value(start) OVER e AS from_start FROM windows WINDOW e AS (PARTITION BY words ORDER BY doc_id, start)
), later AS (
  SELECT *, start > lag(start) OVER (PARTITION BY doc_id ORDER BY start) + 50 AS gap FROM repeated WHERE from_id <> doc_id OR from_start <> start
), passages AS (
  SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start) AS passage FROM later
)
SELECT doc_id, min(start) AS start_word, max(start) + 50 AS end_word, arg_min(from_id, start) AS from_doc_id, arg_min(from_start, start) AS from_word
FROM passages GROUP BY doc_id, passage
"""


@query("op2_suffix_dedup", PASSAGES_SQL)
def op2(spark, sf_dir):
    found = suffixes.repeated_passages(table(spark, sf_dir, "documents"))
    names = {"id": "doc_id", "start": "start_word", "end": "end_word", "from_id": "from_doc_id", "from_start": "from_word"}
    return found.select(*[F.col(a).cast("long").alias(b) for a, b in names.items()])


@query("op4_piece_encoding")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = pieces.decode(pieces.encode(docs))
    text_crc = F.crc32(F.col("text").cast("binary"))
    return found.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_ids"), "ids_crc32", F.octet_length("text").cast("long").alias("decoded_bytes"), text_crc.alias("decoded_crc32"))


@query("op5_license_scan")
def op5(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op11_mixing")
def op11(spark, sf_dir):
    found = mixing.mix(table(spark, sf_dir, "documents")).taken()
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source")


@query("op12_whitening")
def op12(spark, sf_dir):
    found = whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
    return found.withColumn("deviation", F.expr("try_cast(deviation AS long)"))  # null where no long holds it


def _looped(batches):
    """The rows of (id, text, crc) that loop: from word ``a`` on, the text repeats its next ``p`` words."""
    for batch in batches:
        out = []
        for text, crc in zip(batch.column("text").to_pylist(), batch.column("crc").to_pylist(), strict=True):
            g, given = crc // 10, text.encode().split()
            n = len(given)
            if crc % 10 == 0 and n:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                text = b" ".join(given[:a] + [given[a + i % p] for i in range(n - a)]).decode()
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])


def with_loops(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; of a tenth of the documents, as their ids' checksums tell, the text loops."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("crc")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(crc, F.lit(1)).alias("crc"))
    return rows.mapInArrow(_looped, "doc_id long, text string")


@query("op13_periodic_runs")
def op13(spark, sf_dir):
    common.prepare(spark)
    found = runs.collapse_runs(with_loops(table(spark, sf_dir, "documents")))
    longest = runs.longest_run(F.col("runs"))
    rows = found.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"), "runs", "collapsed_sha256")
    return rows.select(
        "doc_id", "n_runs", "longest.start", "longest.length", "longest.period",
        F.expr("1000 * longest.length div longest.period").cast("long").alias("exponent_milli"), F.sha2(runs.run_lines(F.col("runs")).cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256",
    )
