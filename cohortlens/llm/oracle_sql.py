"""DuckDB SQL of the results of the registered queries, where SQL can express them over whole
tables: written from the queries' contracts, not from the operators. Words come from regular
expressions and sets from plain joins, so these statements are for tables that one machine holds.

``op3`` numbers slots in one block of rows, as the operator does up to 800,000 rows. Ids are taken
to be distinct; tests/llm covers repeated and null ids by brute force.
"""
from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_EQUAL_TEXT = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

SQL: dict[str, str] = {
    "op2_near_duplicates": f"""
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS words FROM documents),
        s AS (
            SELECT r, doc_id, CASE
                WHEN len(words) = 0 THEN []
                WHEN len(words) < 2 THEN words
                ELSE list_sort(list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) END AS shingles
            FROM d),
        class AS (
            SELECT row_number() OVER () AS c, shingles, len(shingles) AS n, min(doc_id) AS low FROM s WHERE len(shingles) > 0 GROUP BY shingles),
        item AS (SELECT c, n, unnest(shingles) AS shingle FROM class),
        link AS (
            SELECT a.c AS c1, b.c AS c2
            FROM item a JOIN item b ON a.shingle = b.shingle AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
            GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        edge AS (SELECT c1, c2 FROM link UNION ALL SELECT c2, c1 FROM link),
        reach AS (SELECT c AS c1, c AS c2 FROM class UNION SELECT reach.c1, edge.c2 FROM reach JOIN edge ON edge.c1 = reach.c2),
        component AS (SELECT c1 AS c, min(low) AS component_id FROM reach JOIN class ON class.c = c2 GROUP BY c1)
        SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, coalesce(component_id, s.doc_id) AS component_id,
               s.doc_id = coalesce(component_id, s.doc_id) AS kept
        FROM s LEFT JOIN class USING (shingles) LEFT JOIN component USING (c)""",
    "op3_jump_shards": """
        WITH RECURSIVE bits AS (
            SELECT b, b AS v, 0 AS i FROM range(256) t(b)
            UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i + 1 FROM bits WHERE i < 8),
        crc_table AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE i = 8),
        d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS raw, md5(coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
        size AS (
            SELECT r, doc_id, octet_length(raw) + 1 AS size,
                   xor(4294967295, list_reduce(
                       list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(raw), '..'), lambda x: ('0x' || x)::BIGINT)),
                       lambda crc, byte: xor(crc >> 8, t[1 + (xor(crc, byte) & 255)]))) AS text_crc32
            FROM d, crc_table),
        jump AS (
            SELECT r, shards, ('0x' || substr(digest, 1, 16))::UBIGINT::UHUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j
            FROM d, (VALUES (8), (9)) n(shards)
            UNION ALL
            SELECT r, shards, k2, j, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k2 >> 33) + 1)::DOUBLE))::BIGINT
            FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616::UHUGEINT AS k2 FROM jump WHERE j < shards)),
        shard AS (
            SELECT r, max(b) FILTER (WHERE shards = 8)::INT AS shard, max(b) FILTER (WHERE shards = 9)::INT AS grown_shard FROM jump GROUP BY r)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard,
               row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
        FROM size JOIN shard USING (r)""",
    "op5_substring_dedup": f"""
        WITH d AS (
            SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS words FROM documents),
        w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
        runs AS (
            SELECT r, pos, word, list(word) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS run FROM w),
        seen AS (
            SELECT r, pos, word, len(run) = 20 AND row_number() OVER (PARTITION BY array_to_string(run, ' ') ORDER BY r, pos) > 1 AS again FROM runs),
        marked AS (
            SELECT r, pos, word, bool_or(again) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM seen),
        kept AS (
            SELECT r, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept
            FROM marked GROUP BY r)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (r)""",
    "op6_warc_packages": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
        winner AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS winner, count(*) OVER (PARTITION BY hex) AS n FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
               CASE WHEN n > 1 AND winner IS NOT NULL AND page_id IS DISTINCT FROM winner THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n > 1 AND page_id IS DISTINCT FROM winner THEN winner END AS refers_to
        FROM winner""",
    "op7_decontaminate": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS words FROM documents),
        items AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS words FROM benchmark WHERE item_id IS NOT NULL),
        item_words AS (SELECT item_id, words, generate_subscripts(words, 1) AS pos FROM items),
        grams AS (
            SELECT DISTINCT item_id, least(len(words), 13) AS size, array_to_string(words[pos:pos + 12], ' ') AS gram
            FROM item_words WHERE pos <= greatest(len(words) - 12, 1)),
        w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
        runs AS (SELECT r, pos, list(word) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS run FROM w),
        windows AS (
            SELECT r, pos, size, array_to_string(run[1:size], ' ') AS gram
            FROM runs, (SELECT DISTINCT size FROM grams) WHERE len(run) >= size),
        hits AS (SELECT r, pos, size, item_id FROM windows JOIN grams USING (size, gram)),
        covered AS (
            SELECT r, count(DISTINCT covered_pos) AS n_hit FROM (SELECT r, unnest(range(pos, pos + size)) AS covered_pos FROM (SELECT DISTINCT r, pos, size FROM hits)) GROUP BY r),
        named AS (
            SELECT r, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
            FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hits) GROUP BY r)
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(words), false) AS contaminated
        FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)""",
    "op10_exact_dedup": f"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n_cp, sha256({_EQUAL_TEXT}) AS text_sha256 FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id NULLS LAST) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id NULLS LAST) AS kept,
               text_sha256
        FROM d""",
    "op11_lexical_search": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms, row_number() OVER () AS r
            FROM documents),
        q AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM benchmark),
        size AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
        tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
        w AS (
            SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
            FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), size),
        impact AS (
            SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))) AS impact
            FROM tf JOIN w USING (term), size),
        asked AS (SELECT item_id, unnest(terms) AS term FROM q),
        scored AS (SELECT item_id, r, doc_id, sum(impact)::BIGINT AS score FROM asked JOIN impact USING (term) GROUP BY ALL)
        SELECT item_id, rank::INT AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM scored WHERE score > 0)
        WHERE rank <= 10""",
}
