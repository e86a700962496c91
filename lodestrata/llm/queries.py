"""Queries over the driver's tables, one for each operator; ORACLES has SQL where it can say the same."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, hard_negatives, language_id, license_scan, ngram_join, periodic_runs, piece_lattice, quality, suffix_dedup, suffix_tree, token_counts, warc
from .common import crc_mod, read_table


def tokenizer(name: str) -> str:
    """Place of one of the public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, ~crc_mod("doc_id", 4).eqNullSafe(2))
    out = quality.score(docs.select("doc_id", "text"), model).drop("text")
    return out.select("doc_id", crc_mod("doc_id", 4).eqNullSafe(2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.language_model_scores(read_table(spark, sf_dir, "documents"), crc_mod("doc_id", 5).eqNullSafe(1))


def op5_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_lattice.encode(read_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 4).eqNullSafe(2)
    out = language_id.predict(docs, language_id.train(docs, ~held))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(read_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, records = warc.archive(read_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "bundle", "frame", "offset", "length")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(read_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, label=label)


def planted(doc_id: int | None, n: int) -> np.ndarray:
    """Which word stands at each place: of every tenth document the words from one on repeat with a period."""
    at = np.arange(n)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return at
    g = h // 10
    a = g % n
    return np.where(at >= a, a + (at - a) % (1 + (n - a) // (3 + g % 8)), at)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.periodic_runs(read_table(spark, sf_dir, "documents").select("doc_id", "text"), rewrite=planted)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return out.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), "longest.length", (-F.col("longest.period")).alias("period"),
        F.expr("(1000 * longest.length) div -longest.period").alias("exponent_milli"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents")).drop("blocks")


def license_sql() -> str:
    """The same by comparing every block with every template."""
    known = license_scan.template_tokens(license_scan.TEMPLATES, license_scan.THRESHOLD)
    quoted = lambda x: f"'{x}'"
    template = ", ".join(f"({x['template']}, {quoted(x['label'])}, {t!r}, {x['span']}, {x['need']}, {len(x['tokens'])})" for x in known for t in x["tokens"])
    phrase = ", ".join(f"({quoted(p)}, {quoted(label)}, {len(p.split())})" for p, label in license_scan.PHRASES)
    return f"""
        WITH template(t, label, token, span, need, size) AS (VALUES {template}), phrase(phrase, label, n) AS (VALUES {phrase}),
        doc AS (
            SELECT doc_id AS row, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
        word AS (SELECT row, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM doc WHERE len(words) > 0),
        run AS (SELECT row, i, w, w || ' ' || lead(w) OVER o AS two, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS three FROM word WINDOW o AS (PARTITION BY row ORDER BY i)),
        place AS (SELECT row, i, label FROM run JOIN phrase ON (phrase.n = 2 AND phrase = two) OR (phrase.n = 3 AND phrase = three)),
        base AS (SELECT row, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM place GROUP BY row),
        hit AS (
            SELECT DISTINCT row, t, label, token, need, size, unnest([i // span, i // span - 1]) AS block
            FROM word JOIN template ON w = token),
        met AS (SELECT row, t, label, block, count(*) / any_value(size) AS share FROM hit WHERE block >= 0 GROUP BY row, t, label, block, need HAVING count(*) >= need),
        named AS (SELECT row, label FROM place UNION SELECT row, label FROM met)
        SELECT row AS doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
               coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM place WHERE place.row = doc.row), '') AS base_labels,
               coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM named WHERE named.row = doc.row), '') AS labels,
               CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce((SELECT max(share) FROM met WHERE met.row = doc.row), 0.0)::DOUBLE END AS score
        FROM doc LEFT JOIN base USING (row)
    """


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality, op2_exact_dedup, op3_decontaminate, op4_suffix_tree, op5_piece_lattice, op6_language_id, op7_ngram_join, op8_warc, op9_suffix_dedup, op10_token_counts, op11_hard_negatives, op12_periodic_runs, op13_license_scan)
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
        FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
        WINDOW w AS (PARTITION BY body)
    """,
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
        scored AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.q, c.q) AS BIGINT) AS score
            FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
        positive AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS "rank", n.vec_id AS negative_id, positive_score, n.score AS negative_score
        FROM positive JOIN scored n USING (anchor_id)
        WHERE NOT n.same AND 80 * positive_score <= 100 * n.score AND 100 * n.score <= 100 * positive_score
        QUALIFY "rank" <= 5
    """,
    "op13_license_scan": license_sql(),
}
