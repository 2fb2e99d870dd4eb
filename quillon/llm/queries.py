"""The registered queries of the corpus operators, and their DuckDB SQL where it can express them."""

from __future__ import annotations

from quillon.llm import bpe, encoders, exact_dedup, filter_audit, lexical_search, orc_tokens, packing, pii, quality, sentencepieces, simhash, substring_dedup, tiff, toxicity
from quillon.llm.common import documents, labels, scratch, table


def op1_bpe_round_trip(spark, sf_dir):
    return bpe.round_trip(documents(spark, sf_dir), encoders.path_of(encoders.BYTE_BPE))


def op2_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(documents(spark, sf_dir), digest=True)


def op3_pii(spark, sf_dir):
    return pii.find(documents(spark, sf_dir))


def pii_base_kinds(spark, sf_dir):
    """What op3_pii gives for the base kinds, which SQL can express."""
    return pii.find(documents(spark, sf_dir)).drop("spans")


def op4_orc_tokens(spark, sf_dir):
    path = scratch(spark, "orc_tokens")
    orc_tokens.write_tokens(documents(spark, sf_dir), path, encoders.path_of(encoders.WORD_BPE))
    return orc_tokens.summary(spark, path)


def op5_tiff_media(spark, sf_dir):
    return tiff.store_texts(documents(spark, sf_dir))


def tiff_pages(spark, sf_dir):
    """One row per page of the documents' files."""
    return tiff.text_pages(documents(spark, sf_dir))


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op7_best_fit_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), encoders.path_of(encoders.BYTE_BPE))


def op8_simhash_near_dedup(spark, sf_dir):
    return simhash.near_groups(documents(spark, sf_dir))


def op10_quality_cnn(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.trained(docs, labels(spark, sf_dir)))


def op9_toxicity_kernel(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.trained(docs, labels(spark, sf_dir)))


def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit(documents(spark, sf_dir), labels(spark, sf_dir))


def op12_sentencepiece(spark, sf_dir):
    return sentencepieces.round_trip(documents(spark, sf_dir), encoders.path_of(sentencepieces.PIECE_BPE))


def op13_lexical_search(spark, sf_dir):
    return lexical_search.ranked(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_pii": op3_pii,
    "op4_orc_tokens": op4_orc_tokens,
    "op5_tiff_media": op5_tiff_media,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_toxicity_kernel": op9_toxicity_kernel,
    "op10_quality_cnn": op10_quality_cnn,
    "op11_filter_audit": op11_filter_audit,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_lexical_search": op13_lexical_search,
    "pii_base_kinds": pii_base_kinds,
    "tiff_pages": tiff_pages,
}



def _matches(kind: str, pattern: str) -> str:
    """SQL for (doc_id, row, kind, start, m): the leftmost matches of a pattern, placed by the lengths of what stands between them."""
    return rf"""
        SELECT doc_id, r, '{kind}' AS kind, m,
               CAST(list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS start
        FROM (SELECT doc_id, r, ms, gaps, unnest(range(1, len(ms) + 1)) AS k, unnest(ms) AS m
              FROM (SELECT doc_id, r, regexp_extract_all(body, '{pattern}') AS ms, string_split_regex(body, '{pattern}') AS gaps FROM d))"""


_LUHN = """list_sum(list_transform(list_reverse(string_split(regexp_replace(m, '[^0-9]', '', 'g'), '')),
             lambda x, i: CASE WHEN i % 2 = 1 THEN CAST(x AS INT) WHEN CAST(x AS INT) > 4 THEN 2 * CAST(x AS INT) - 9 ELSE 2 * CAST(x AS INT) END)) % 10 = 0"""

ORACLES = {
    "op2_substring_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS (SELECT r, doc_id, k, array_to_string(w[k:k + 12], ' ') AS words FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d)),
        least AS (SELECT words, min(doc_id) AS first_id FROM windows GROUP BY words),
        gone AS (SELECT DISTINCT r, k + j AS k FROM windows JOIN least USING (words), range(13) AS t(j) WHERE first_id < doc_id),
        kept AS (SELECT r, string_agg(word, ' ' ORDER BY k) AS body, count(*) AS n
                 FROM (SELECT r, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d) ANTI JOIN gone USING (r, k) GROUP BY r)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (r)""",
    "pii_base_kinds": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
        found AS (
            SELECT *, 0 AS o FROM ({_matches("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")})
            UNION ALL SELECT *, 1 FROM ({_matches("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")})
                WHERE list_max(list_transform(string_split(m, '.'), lambda x: CAST(x AS HUGEINT))) <= 255
            UNION ALL SELECT *, 2 FROM ({_matches("card", r"[0-9](?:[\x20-]?[0-9])+")})
                WHERE length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND {_LUHN}
            UNION ALL SELECT *, 3 FROM ({_matches("phone", r"\+[0-9][\x20().0-9-]+[0-9]")})
                WHERE length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15),
        sums AS (SELECT r, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
                        count(*) FILTER (kind = 'phone') AS n_phone,
                        string_agg(concat(kind, ':', start, ':', start + length(m)), ',' ORDER BY o, start) AS shown FROM found GROUP BY r)
        SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
               sha256(coalesce(shown, '')) AS base_sha256
        FROM d LEFT JOIN sums USING (r)""",
    "op6_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, sha256(body) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY body)""",
    "op13_lexical_search": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
                          lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS t FROM documents),
        q AS (SELECT row_number() OVER () AS i, item_id, list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
                     lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS t FROM benchmark),
        asked AS (SELECT i, item_id, unnest(t) AS term FROM q),
        size AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
        tf AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(t) AS term FROM d) SEMI JOIN asked USING (term) GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, size GROUP BY term, n_docs),
        m AS (SELECT r, doc_id, 100 - 90 + ((90 * CAST(len(t) AS BIGINT) * n_docs) // n_terms) AS m FROM d, size),
        scored AS (SELECT i, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY i, r)
        SELECT item_id, CAST(n AS INT) AS rank, doc_id, score
        FROM (SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS n FROM scored JOIN d USING (r) WHERE score > 0) JOIN q USING (i)
        WHERE n <= 10""",
    "op11_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                     list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN len(w) < 200 WHEN 'B' THEN 100 * len(list_distinct(w)) < 50 * len(w)
                         WHEN 'C' THEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body) WHEN 'D' THEN regexp_matches(body, '[#$%&*|]')
                         ELSE coalesce(doc_id > least, false) END) AS failed
              FROM (SELECT *, min(doc_id) OVER (PARTITION BY body) AS least FROM d) LEFT JOIN l USING (doc_id)),
        c AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s AS (SELECT o, k, o[k] AS filter, o[1:k - 1] AS before FROM o, range(1, 6) AS t(k)),
        r AS (SELECT part, o, k, filter,
                     sum(CASE WHEN NOT list_contains(failed, filter) AND NOT list_has_any(failed, before) THEN n ELSE 0 END) AS kept,
                     sum(CASE WHEN list_contains(failed, filter) AND NOT list_has_any(failed, before) THEN n ELSE 0 END) AS removed,
                     sum(CASE WHEN list_contains(failed, filter) AND list_has_any(failed, before) THEN n ELSE 0 END) AS redundant,
                     sum(CASE WHEN failed = [filter] THEN n ELSE 0 END) AS unique_fails,
                     sum(CASE WHEN list_contains(failed, filter) AND NOT list_has_any(failed, before) THEN good ELSE 0 END) AS good_lost,
                     sum(CASE WHEN list_contains(failed, filter) AND NOT list_has_any(failed, before) THEN toxic ELSE 0 END) AS toxic_lost
              FROM c, s GROUP BY ALL)
        SELECT part, array_to_string(o, '') AS filter_order, CAST(k AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
        FROM r""",
}
