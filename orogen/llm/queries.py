"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import classifier, decontamination, langid, ngrams, passages, phrases, pii, rules, sentencepieces, simhash, toxicity, vectorcodes, warc


#: The model of op8_sentencepiece and of the pipeline; sentencepieces.load() takes any path.
PIECES = os.environ.get("OROGEN_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
#: The key of the pseudonyms. Whoever runs these queries for more than a check sets one of their own.
PII_KEY = os.environ.get("OROGEN_PII_KEY", "for checks alone")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(spark, _table(spark, sf_dir, "pages")).drop("target_uri")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.scores(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"), PII_KEY)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(_table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encoded(_table(spark, sf_dir, "documents"), sentencepieces.load(PIECES))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compressed(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_warc": op2_warc,
    "op3_decontamination": op3_decontamination,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_pii": op5_pii,
    "op6_language_id": op6_language_id,
    "op7_simhash": op7_simhash,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_toxicity": op12_toxicity,
    "op13_vector_codes": op13_vector_codes,
}



def _codes_sql(rounds: int = 4) -> str:
    """Rounds of assignment a<k> by codebook b<k - 1>, whose entries' means make b<k>."""
    nearest = lambda k: f"""
        a{k} AS (SELECT vec_id, parts.p, parts.v, min(list_sum(list_transform(list_zip(parts.v, b.v), lambda t: ((t[1] - t[2]) * (t[1] - t[2]))::HUGEINT))::HUGEINT * 256 + b.e) AS near
                 FROM parts JOIN b{k} AS b ON b.p = parts.p GROUP BY vec_id, parts.p, parts.v)"""  # noqa: E731
    moved = lambda k: f"""
        s{k} AS (SELECT p, e, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n
                 FROM (SELECT p, near % 256 AS e, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{k}) GROUP BY p, e, i),
        m{k} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{k} GROUP BY p, e),
        b{k + 1} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{k} AS b LEFT JOIN m{k} AS m ON m.p = b.p AND m.e = b.e)"""  # noqa: E731
    steps = ",".join(nearest(k) + "," + moved(k) for k in range(rounds))
    return f"""
        WITH kept AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS (SELECT vec_id, p, list_transform(embedding[p * (len(embedding) // 4) + 1 : (p + 1) * (len(embedding) // 4)], lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
                  FROM kept CROSS JOIN (SELECT unnest(range(4)) AS p)),
        b0 AS (SELECT p, (row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1)::HUGEINT AS e, v FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)),
        {steps},{nearest(rounds)},
        told AS (SELECT vec_id, string_agg(printf('%02x', (near % 256)::INTEGER), '' ORDER BY p) AS code, sum(near // 256)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
        digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM told JOIN kept USING (vec_id) CROSS JOIN digest"""


_DIGEST = "translate(concat(" + ", ".join(f"to_base(('0x' || substr(sha1(p), {1 + 10 * k}, 10))::BIGINT, 32, 8)" for k in range(4)) + "), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"

_PHRASES_SQL = r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
        cut AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
        placed AS (SELECT lang, ws, k, unnest(range(len(ws) - k + 1)) AS i FROM cut CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k),
        f AS (SELECT lang, array_to_string(ws[i + 1 : i + k], ' ') AS phrase, k, count(*) AS a FROM placed GROUP BY ALL),
        n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT lang, phrase, string_split(phrase, ' ') AS ws, k, a FROM f WHERE k > 1 AND a >= 30),
        starts AS (SELECT lang, phrase, ws, k, a, j, unnest(range(k - j + 1)) AS i FROM c CROSS JOIN (SELECT unnest([2, 3]) AS j) WHERE k > j),
        covered AS (SELECT lang, array_to_string(ws[i + 1 : i + j], ' ') AS phrase, max(a) AS longer FROM starts GROUP BY ALL),
        alone AS (SELECT c.* FROM c LEFT JOIN covered USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * c.a),
        cuts AS (SELECT lang, phrase, a, w, array_to_string(ws[1 : w], ' ') AS head, array_to_string(ws[w + 1 : k], ' ') AS tail FROM alone CROSS JOIN (SELECT unnest([1, 2, 3]) AS w) WHERE w < k),
        scored AS (SELECT cuts.lang, cuts.phrase, cuts.a, w, h.a AS l, t.a AS r, (2000000::HUGEINT * cuts.a // (h.a + t.a))::BIGINT AS score
                   FROM cuts JOIN f AS h ON h.lang = cuts.lang AND h.phrase = cuts.head JOIN f AS t ON t.lang = cuts.lang AND t.phrase = cuts.tail),
        best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, w) AS cut FROM scored),
        ranked AS (SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE cut = 1)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""

ORACLES: dict[str, str] = {
    "op2_warc": f"""
        WITH recs AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
        first AS (SELECT p, min(page_id) AS response_id FROM recs GROUP BY p)
        SELECT page_id, strlen(p)::BIGINT AS payload_bytes, {_DIGEST} AS payload_digest,
               CASE WHEN page_id = response_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> response_id THEN response_id END AS refers_to
        FROM recs JOIN first USING (p)""",
    "op4_lm_scoring": r"""
        WITH cut AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM cut),
        pairs AS (SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM words),
        one AS (SELECT w, count(*)::DOUBLE AS c FROM words GROUP BY w),
        two AS (SELECT p, w, count(*)::DOUBLE AS c FROM pairs WHERE p IS NOT NULL GROUP BY p, w),
        n AS (SELECT count(*)::DOUBLE AS n FROM words),
        told AS (SELECT doc_id, pairs.p IS NOT NULL AND two.c < 2 AS backed,
                        CASE WHEN two.c >= 2 THEN ln(two.c / before.c) WHEN pairs.p IS NULL THEN ln(one.c / n) ELSE ln(one.c / n) + ln(0.4) END AS s
                 FROM pairs CROSS JOIN n JOIN one USING (w) LEFT JOIN two ON two.p = pairs.p AND two.w = pairs.w LEFT JOIN one AS before ON before.w = pairs.p),
        sums AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (backed) AS n_backoffs, round(sum(s), 6) AS log_score FROM told GROUP BY doc_id)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_backoffs, 0) AS n_backoffs, coalesce(log_score, 0.0) AS log_score, log_score / n_words AS mean_log_score
        FROM documents LEFT JOIN sums USING (doc_id)""",
    "op11_phrase_mining": _PHRASES_SQL,
    "op13_vector_codes": _codes_sql(),
}
