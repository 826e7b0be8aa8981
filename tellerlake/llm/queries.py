"""Registered queries of this subpackage, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellerlake.llm import ann, bpe, contamination, fragments, gnat, licenses, neardup, quality, repair, substrings, tokens, urls, warc
from tellerlake.llm.common import read, whole_texts, written
from tellerlake.session import use_utc

TOKEN_LIMIT = 1024
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(use_utc(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


@query
def op1_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    scored = quality.quality_scores(docs, model)
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", "predicted")


@query
def op2_substring_dedup(spark, sf_dir):
    kept = substrings.without_repeats(read(whole_texts(spark), sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_token_counts(spark, sf_dir):
    return tokens.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), TOKEN_LIMIT)


@query
def op4_url_filter(spark, sf_dir):
    return urls.url_verdicts(read(spark, sf_dir, "pages"), URL_RULES)


@query
def op5_near_duplicates(spark, sf_dir):
    return neardup.classes(read(spark, sf_dir, "documents"))


@query
def op6_nearest_vectors(spark, sf_dir):
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query
def op7_byte_bpe(spark, sf_dir):
    return bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op8_warc(spark, sf_dir):
    return warc.archive_round_trip(read(spark, sf_dir, "pages"))


@query
def op9_decontamination(spark, sf_dir):
    return contamination.contaminated_pairs(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op10_license_scan(spark, sf_dir):
    return licenses.license_scan(read(spark, sf_dir, "documents"))


@query
def op11_conversation_repair(spark, sf_dir):
    rows = written(repair.ordered(repair.damaged(read(spark, sf_dir, "conversations"))), "turns")
    found = written(repair.report(rows), "repairs")
    made = repair.digests(rows, found).withColumnRenamed("conv_id", "of")
    return found.join(made, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")


@query
def op12_vector_codes(spark, sf_dir):
    made = gnat.compress(read(spark, sf_dir, "embeddings"))
    return made.rows.select("vec_id", "code", "error", "label_error", F.lit(made.digest()).alias("codebooks_sha256"))


@query
def op13_fragment_bpe(spark, sf_dir):
    return fragments.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


SQL["op2_substring_dedup"] = r"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM rows WHERE len(w) >= 35),
windows AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM places),
again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM windows WHERE h IN (SELECT h FROM again)),
lists AS (SELECT r, list(i) AS g FROM gone GROUP BY r),
marked AS (SELECT r, doc_id, w, coalesce(g, []) AS g FROM rows LEFT JOIN lists USING (r)),
kept AS (SELECT r, array_to_string(list(word ORDER BY i), ' ') AS t FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM rows) x WHERE NOT EXISTS (SELECT 1 FROM gone y WHERE y.r = x.r AND y.i = x.i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, len(g)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM marked LEFT JOIN kept USING (r)
"""

SQL["op8_warc"] = """
WITH payloads AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT h, min(page_id) AS first FROM payloads GROUP BY h)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (j // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (j % 4))) & 31)::INTEGER + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM payloads JOIN firsts USING (h)
"""


def vector_codes_sql(parts: int = gnat.PARTS, entries: int = gnat.ENTRIES, rounds: int = gnat.ROUNDS) -> str:
    """The rounds written out one by one: `near` picks each part's entry, the next `book` averages. The least of distance * entries + index is the nearest."""
    apart = "list_sum(list_transform(range(1, len(x) + 1), lambda j: (x[j] - y[j]) * (x[j] - y[j])))::BIGINT"
    steps = [
        f"""known AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, vec_id, label, v FROM (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({gnat.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))""",
        f"cut AS (SELECT r, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM known, range(0, {parts}) t(p))",
        f"book0 AS (SELECT p, r - 1 AS e, x AS y FROM cut WHERE r <= {entries})",
    ]
    for i in range(rounds + 1):
        steps.append(f"near{i} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, min({apart} * {entries} + e) AS m FROM cut JOIN book{i} USING (p) GROUP BY r, p)")
        if i < rounds:
            steps.append(f"sums{i} AS (SELECT p, e, j, count(*) AS n, sum(c) AS s FROM (SELECT p, m % {entries} AS e, unnest(range(1, len(x) + 1)) AS j, unnest(x) AS c FROM near{i}) GROUP BY p, e, j)")
            steps.append(f"mean{i} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j)::BIGINT[] AS y FROM sums{i} GROUP BY p, e)")
            steps.append(f"book{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.y, b.y) AS y FROM book{i} b LEFT JOIN mean{i} m USING (p, e))")
    return f"""
WITH {", ".join(steps)},
coded AS (SELECT r, string_agg(printf('%02x', m % {entries}), '' ORDER BY p) AS code, sum(m // {entries})::BIGINT AS error FROM near{rounds} GROUP BY r),
named AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN known USING (r), named
"""


SQL["op12_vector_codes"] = vector_codes_sql()
