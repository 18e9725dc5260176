"""The registered queries of the text operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import bpe, decontaminate, langid, license_scan, near_dedup, nearest, negatives, pii, quality, sharding, suffix_dedup, toxicity, whitening
from gridspark.llm.common import table


def vocabulary() -> tuple[str, str]:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("rejected_by")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *vocabulary())


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest.search(rows, rows.where("vec_id % 50 = 0"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return negatives.hard_negatives(rows, rows.where("vec_id % 100 = 0"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_minhash_near_dedup, op2_quality_rules, op3_toxicity, op4_suffix_dedup, op5_language_id, op6_license_scan, op7_byte_bpe, op8_decontamination, op9_sharding, op10_pii, op11_nearest_neighbours, op12_hard_negatives, op13_whitening)
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANK, OTHER = r"[\x20\x09-\x0D]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split_sql(text: str, ends_word: str) -> str:
    return f"list_filter(string_split_regex({text}, '{ends_word}'), lambda x: x <> '')"


FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
INNER = "list_reduce(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]), lambda a, b: a + b)"

ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": f"""WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, {split_sql(LOWER, BLANK)} AS w FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
        n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
        pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
        e AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
        reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
        c AS (SELECT a AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = b GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c USING (r) LEFT JOIN n USING (r)""",
    "op2_quality_rules": f"""WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, coalesce(text, '') AS t, {split_sql("coalesce(text, '')", BLANK)} AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        g AS MATERIALIZED (SELECT r, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
        twice AS (SELECT r, g FROM g GROUP BY r, g HAVING count(*) > 1),
        hit AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT g.r, unnest(range(i, i + 5)) AS k FROM g JOIN twice USING (r, g)) GROUP BY r),
        m AS (SELECT doc_id, len(w)::bigint AS n_words, length(array_to_string(w, ''))::bigint AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint AS n_symbols,
            length(regexp_replace(t, '[^!]+', '', 'g'))::bigint AS n_exclaims, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters, len(l) AS n_lines,
            (len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::bigint AS n_dup_lines, coalesce(hit.n, 0)::bigint AS n_repeat_words
            FROM d LEFT JOIN hit USING (r))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
            NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR n_symbols > 0.2 * n_words OR n_exclaims > 0.5 * n_words OR n_stutters > 0.3 * n_words OR (n_dup_lines > 3 AND 100 * n_dup_lines > 30 * n_lines) OR word_chars > 25 * n_words OR word_chars < 1.5 * n_words) AS kept FROM m""",
    # Two hexadecimal digits a byte; windows meet by md5, runs are islands of starts at most 400 apart.
    "op4_suffix_dedup": """WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS MATERIALIZED (SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT r, h, unnest(range(0, greatest(length(h) // 2 - 399, 0))) AS i FROM d)),
        starts AS (SELECT r, i FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
        o AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM starts),
        g AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS island FROM o),
        runs AS (SELECT r, min(i) AS lo, max(i) + 400 AS hi FROM g GROUP BY r, island),
        s AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS before FROM runs),
        parts AS (SELECT s.r, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS head, max(hi) AS tail, sum(hi - lo) AS removed, count(*) AS n FROM s JOIN d USING (r) GROUP BY s.r)
        SELECT doc_id, (length(h) // 2)::bigint AS n_bytes, coalesce(removed, 0)::bigint AS n_removed, coalesce(n, 0)::bigint AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1, length(h)))) AS kept_sha256 FROM d LEFT JOIN parts USING (r)""",
    "op8_decontamination": f"""WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, {split_sql(LOWER, OTHER)} AS w FROM documents),
        b AS (SELECT item_id::varchar AS item, {split_sql(LOWER, OTHER)} AS w FROM benchmark WHERE item_id IS NOT NULL),
        win AS MATERIALIZED (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
        grams AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT r, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, (SELECT DISTINCT n FROM win))),
        hit AS MATERIALIZED (SELECT r, i, grams.n, item FROM grams JOIN win ON win.n = grams.n AND win.g = grams.g),
        spans AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
        names AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
        SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN spans USING (r) LEFT JOIN names USING (r)""",
    # Sums run from the first coordinate to the last, as in the operator.
    "op11_nearest_neighbours": f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS e FROM embeddings WHERE {FINITE}),
        n AS MATERIALIZED (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS norm FROM v),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, {INNER.format("q.e", "c.e")} / (q.norm * c.norm) AS score FROM n q, n c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND q.norm > 0 AND c.norm > 0),
        r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::int AS rank, vec_id, score FROM s) SELECT * FROM r WHERE rank <= 5""",
    "op12_hard_negatives": f"""WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS e FROM embeddings WHERE label IS NOT NULL AND {FINITE}),
        s AS MATERIALIZED (SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same, ({INNER.format("a.e", "c.e")})::bigint AS s FROM v a, v c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
        p AS (SELECT a, c AS positive, s AS ps FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, c) AS k FROM s WHERE same) WHERE k <= 5),
        r AS (SELECT p.a AS anchor_id, positive AS positive_id, (row_number() OVER (PARTITION BY p.a, positive ORDER BY s DESC, c))::int AS rank, c AS negative_id, ps AS positive_score, s AS negative_score FROM p JOIN s ON s.a = p.a AND NOT same AND 30 * ps <= 100 * s AND 100 * s <= 90 * ps)
        SELECT * FROM r WHERE rank <= 10""",
}
