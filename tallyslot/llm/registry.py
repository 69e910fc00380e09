"""The queries of this package: thin digests of the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from tallyslot.llm import (
    collocations, exact_copies, filter_audit, jaccard_segments, language_spans, license_rules, phrase_index, pii_segments, piece_trie,
    repair_store, repetition, token_resync, toxic_lm,
)
from tallyslot.llm.common import column, held_out, table, vocabulary_file
from tallyslot.sources.workdir import fresh_folder

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_rules(spark: SparkSession, folder: str) -> DataFrame:
    return license_rules.scan(table(spark, folder, "documents"))


def op2_language_spans(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language_spans.identify(docs, language_spans.train(docs))
    return found.select("doc_id", held_out(column("doc_id")).alias("held_out"), "lang_pred", "score", "n_spans")


def op3_repetition(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.quality(table(spark, folder, "documents"))


def op4_piece_trie(spark: SparkSession, folder: str) -> DataFrame:
    return piece_trie.digests(table(spark, folder, "documents"), vocabulary_file("piece_bpe_32k.model"))


def op5_repair_store(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_folder(spark, "id-store")
    repair_store.write(table(spark, folder, "documents"), vocabulary_file("byte_bpe_50k.json"), path)
    return repair_store.read_back(repair_store.read(spark, path))


def op6_toxic_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = toxic_lm.toxicity(docs, toxic_lm.train(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out(column("doc_id")).alias("held_out"), "score", "predicted")


def op7_phrase_index(spark: SparkSession, folder: str) -> DataFrame:
    return phrase_index.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_hash")


def op8_jaccard_segments(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_segments.jaccard_components(table(spark, folder, "documents"))


def op9_pii_segments(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pii_segments.find(docs, pii_segments.train(docs))


def op10_token_resync(spark: SparkSession, folder: str) -> DataFrame:
    return token_resync.token_counts(table(spark, folder, "documents"), vocabulary_file("word_bpe_49k.json"))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.top_phrases(table(spark, folder, "documents"))


def op13_exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    return exact_copies.copies(table(spark, folder, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_license_rules": op1_license_rules,
        "op2_language_spans": op2_language_spans,
        "op3_repetition": op3_repetition,
        "op4_piece_trie": op4_piece_trie,
        "op5_repair_store": op5_repair_store,
        "op6_toxic_lm": op6_toxic_lm,
        "op7_phrase_index": op7_phrase_index,
        "op8_jaccard_segments": op8_jaccard_segments,
        "op9_pii_segments": op9_pii_segments,
        "op10_token_resync": op10_token_resync,
        "op11_filter_audit": op11_filter_audit,
        "op12_collocations": op12_collocations,
        "op13_exact_copies": op13_exact_copies,
        "pipeline": corpus_pipeline.run,
    }


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

PHRASES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
placed AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS k FROM placed),
sizes AS (SELECT DISTINCT n FROM windows),
starts AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes),
met AS (SELECT DISTINCT p.r, p.s, p.n, x.item_id
        FROM (SELECT r, s, n, array_to_string(w[s : s + n - 1], ' ') AS k FROM starts) p JOIN windows x ON p.n = x.n AND p.k = x.k),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM met) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM met WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits ON d.r = hits.r LEFT JOIN items ON d.r = items.r
"""

COMPONENTS = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
placed AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS s FROM d WHERE len(w) > 0),
g AS (SELECT DISTINCT doc_id, array_to_string(w[s : s + 3], ' ') AS k FROM placed),
sizes AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, ways.y FROM reach JOIN ways ON reach.b = ways.x)
SELECT d.doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles, min(reach.b) AS component_id
FROM d LEFT JOIN sizes ON sizes.doc_id = d.doc_id JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id
"""

AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t),
              regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS fails
      FROM d LEFT JOIN m ON d.doc_id = m.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || e.x || g.x AS filter_order FROM letters a, letters b, letters c, letters e, letters g
           WHERE len(list_distinct([a.x, b.x, c.x, e.x, g.x])) = 5),
steps AS (SELECT filter_order, CAST(s AS INTEGER) AS step, ascii(filter_order[s]) - 64 AS k,
                 [ascii(filter_order[i]) - 64 FOR i IN range(1, s)] AS prior FROM orders, range(1, 6) r(s)),
g AS (SELECT part, fails, good, toxic, count(*) AS n, len(list_filter(fails, lambda x: x)) AS n_fails FROM f GROUP BY ALL),
r AS (SELECT part, filter_order, step, k, fails[k] AS hit, len(list_filter(prior, lambda i: fails[i])) > 0 AS gone, good, toxic, n, n_fails FROM g, steps),
s AS (SELECT part, filter_order, step, k, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed,
             coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (hit AND n_fails = 1), 0) AS unique_fails,
             coalesce(sum(n) FILTER (hit AND NOT gone AND good), 0) AS good_lost, coalesce(sum(n) FILTER (hit AND NOT gone AND toxic), 0) AS toxic_lost
      FROM r GROUP BY part, filter_order, step, k)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM s
"""

COLLOCATIONS = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all({LOWERED}, '[^.,;:!?\x0A-\x0D]+') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM d),
c AS (SELECT lang, k, g, count(*) AS f FROM (
          SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS g
          FROM p, range(1, 4) r(k) WHERE len(w) >= k) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM c WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, k, g, a, unnest(range(1, k)) AS cut, w FROM cand),
scored AS (SELECT cuts.lang, cuts.k, cuts.g, a, cut, x.f AS l, y.f AS r,
                  CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
           FROM cuts JOIN c x ON x.lang = cuts.lang AND x.g = array_to_string(w[1 : cut], ' ') AND x.k = cut
                     JOIN c y ON y.lang = cuts.lang AND y.g = array_to_string(w[cut + 1 : cuts.k], ' ') AND y.k = cuts.k - cut),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
covers AS (SELECT lang, part, max(a) AS longer FROM (
               SELECT lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS part FROM cand WHERE k = 3) GROUP BY ALL)
SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score
FROM best JOIN totals ON totals.lang = best.lang LEFT JOIN covers ON k = 2 AND covers.lang = best.lang AND covers.part = g
WHERE longer IS NULL OR 100 * longer < 50 * a QUALIFY rank <= 2000
"""

COPIES = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can express a query on whole tables; the others are tested against brute force and libraries."""
    return {
        "op7_phrase_index": PHRASES, "op8_jaccard_segments": COMPONENTS, "op11_filter_audit": AUDIT, "op12_collocations": COLLOCATIONS,
        "op13_exact_copies": COPIES,
    }
