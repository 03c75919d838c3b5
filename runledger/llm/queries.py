"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm import crossentropy, exact_stream, minhash, mixing, packing, pivots, ppm, ranked, repeats, toxicity, warc, whitening
from runledger.llm.common import stored


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_stream.exact_dedup(read(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the packed matrices of all documents, read them back and return one row a sequence."""
    rows = stored(packing.pack_best_fit(read(spark, sf_dir, "documents"), tokenizer_path()), "matrices")
    return rows.select("sequence_id", "n_tokens", "cu_seqlens", "doc_ids", "starts", F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_components(read(spark, sf_dir, "documents"), k=2).select("doc_id", "n_shingles", "component_id", "kept")


def op4_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_tiers(read(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.held_out_prediction(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op9_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as of good quality."""
    return crossentropy.cross_entropy_difference(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where("quality = 1"))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(read(spark, sf_dir, "embeddings"))


def op11_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All copies of repeated strings of 400 bytes go, the first too."""
    rest = repeats.remove_repeats(read(spark, sf_dir, "documents"), plain=True)
    return rest.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item against all documents."""
    return ranked.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_token_matrices, op3_near_dedup, op4_tier_packing, op5_language_id, op6_toxicity, op7_exact_dedup, op8_warc_segments, op9_cross_entropy, op10_near_vectors, op11_repeated_bytes, op12_whitening, op13_ranked_search)}

_REACHED = """reach AS (SELECT id, id AS to_id FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.to_id)"""

ORACLES: dict[str, str] = {
    "op3_near_dedup": r"""WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  nodes AS (SELECT id FROM w),
  s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE [w[i] || chr(0) || w[i + 1] FOR i IN range(1, len(w))] END) AS g FROM w),
  n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
  p AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.id <> y.id GROUP BY ALL),
  links AS (SELECT a, b FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
  """ + _REACHED + """ SELECT r.id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(to_id) AS component_id, r.id = min(to_id) AS kept FROM reach r LEFT JOIN n ON n.id = r.id GROUP BY r.id""",
    "op7_exact_dedup": r"""WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS c, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
  k AS (SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY c DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
  SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM k""",
    "op8_warc_segments": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), g AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p),
  r AS (SELECT *, payload_bytes >= 100 AND page_id <> first AS again FROM g)
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to, NULL::VARCHAR AS problem FROM r""",
    "op10_near_vectors": """WITH RECURSIVE nodes AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
  ok AS (SELECT * FROM nodes WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
  links AS (SELECT x.id AS a, y.id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.id <> y.id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
  """ + _REACHED + """ SELECT r.id AS vec_id, (SELECT count(*) FROM links WHERE a = r.id) AS n_links, min(to_id) AS component_id, r.id = min(to_id) AS kept FROM reach r GROUP BY r.id""",
    "op13_ranked_search": r"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
  t AS (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM w), p AS (SELECT doc_id, n, t, count(*) AS tf FROM t GROUP BY ALL),
  s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS total FROM w WHERE len(w) > 0),
  q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
  d AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY t),
  c AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score FROM q JOIN d USING (t) JOIN p USING (t), s GROUP BY ALL)
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM c WHERE score > 0 QUALIFY rank <= 50""",
}
