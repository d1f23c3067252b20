"""SQL for DuckDB that gives the same rows as the queries, where SQL can express them."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# Table-driven CRC-32 over the hex digits of the bytes; the table follows from the polynomial.
CRC32 = """
crc_step AS (
    SELECT list(v ORDER BY b) AS t FROM (
        WITH RECURSIVE s(b, i, v) AS (
            SELECT b, 0, b::BIGINT FROM range(256) r(b)
            UNION ALL
            SELECT b, i + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM s WHERE i < 8
        ) SELECT b, v FROM s WHERE i = 8)
), sized AS (
    SELECT doc_id, source, octet_length(data) + 1 AS size,
        xor(list_reduce(
            list_prepend(4294967295::BIGINT, [('0x' || h)::BIGINT FOR h IN regexp_extract_all(hex(data), '..')]),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
    FROM (SELECT doc_id, source, encode(coalesce(text, '')) AS data FROM documents), crc_step
)"""

ORACLES["op1_interleaved_shards"] = f"""
WITH {CRC32}, ranked AS (
    SELECT *, substr(md5('interleave-1|' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS o,
        count(*) OVER (PARTITION BY source) AS total, count(*) OVER () AS n
    FROM sized
), shares AS (
    SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY o, doc_id, text_crc32, size) - 1)
        / (2 * total) AS share FROM ranked
), placed AS (
    SELECT *, row_number() OVER (ORDER BY share, o, doc_id, text_crc32, size) - 1 AS p FROM shares
), cut AS (SELECT *, (p * 16) // n AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard,
    (p - (shard * n + 15) // 16)::BIGINT AS slot, NULL::INT AS grown_shard
FROM cut"""

# Escaping adds one character per backslash and per control string; a line end in a role adds four.
ESCAPED_LENGTH = """length({0}) + length({0}) - length(replace({0}, '\\', ''))
    + len(regexp_extract_all({0}, '<\\||<s>|</s>|\\[INST\\]|\\[/INST\\]|<<SYS>>|<</SYS>>'))"""

ORACLES["op4_prefix_targets"] = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sizes AS (
    SELECT *, row_number() OVER w AS k, sum(24 + {ESCAPED_LENGTH.format("role")}
            + 4 * (length(role) - length(replace(role, chr(10), ''))) + {ESCAPED_LENGTH.format("text")})
            OVER (w ROWS UNBOUNDED PRECEDING) AS upto,
        count(*) OVER (PARTITION BY conv_id) AS n
    FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    length(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(CASE WHEN role = 'assistant' OR k = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars,
    count(*) FILTER (role = 'assistant' OR k = n) AS n_examples
FROM sizes GROUP BY conv_id"""

ORACLES["op9_host_rules"] = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), words AS (
    SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i
    FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs)
), word_sums AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY r
), runs AS (
    SELECT r, i, word AS a, lead(word) OVER w AS b, lead(word, 2) OVER w AS c
    FROM words WINDOW w AS (PARTITION BY r ORDER BY i)
), again AS (
    SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) > 1 AS hit FROM runs WHERE c IS NOT NULL
), covered AS (
    SELECT r, count(DISTINCT i + d) AS n_repeat_words FROM again, range(3) s(d) WHERE hit GROUP BY r
), lines AS (
    SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), measured AS (
    SELECT doc_id, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
    FROM docs LEFT JOIN word_sums USING (r) LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)
), judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
), hosts AS (
    SELECT source AS host, count(*) AS n_docs, count(*) FILTER (
        base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
        OR word_chars < 3 * n_words OR word_chars > 12 * n_words) AS n_failed
    FROM judged GROUP BY 1
), moments AS (
    SELECT avg(n_failed / n_docs) AS mean, var_samp(n_failed / n_docs) AS variance FROM hosts
), prior AS (
    SELECT mean, CASE WHEN variance IS NULL THEN 2 WHEN variance = 0 THEN 1e6
        ELSE least(1e6, greatest(2, mean * (1 - mean) / variance - 1)) END AS strength FROM moments
), verdicts AS (
    SELECT host, (n_failed + mean * strength) / (n_docs + strength) AS host_rate FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed,
    round(host_rate, 6) AS host_rate, NOT base_failed AND host_rate <= 0.5 AS kept
FROM judged JOIN verdicts ON source IS NOT DISTINCT FROM host"""

ORACLES["op3_template_lines"] = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), placed AS (
    SELECT r, doc_id, text, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs
), parsed AS (
    SELECT *, [CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END
        FOR t IN regexp_extract_all(line, '[^\x20\x09-\x0D]+')] AS parts FROM placed
), held AS (
    SELECT *, len(parts) AS n, len(parts) || ' ' || array_to_string(parts[1:3], ' ') AS leaf,
        array_to_string(parts, ' ') AS masked,
        array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ') AS literal FROM parsed WHERE len(parts) > 0
), forms AS (
    SELECT leaf, masked, any_value(parts) AS parts, any_value(n) AS n, count(DISTINCT text) AS n_texts,
        len(list_filter(any_value(parts), lambda t: t <> '<*>')) AS fixed
    FROM held SEMI JOIN (SELECT leaf FROM held GROUP BY 1 HAVING count(DISTINCT text) >= 3) USING (leaf)
    WHERE n >= 5 GROUP BY 1, 2
), fields AS (
    SELECT *, unnest(parts) AS token, generate_subscripts(parts, 1) AS place FROM forms
), constant AS (
    SELECT leaf, place, token FROM fields WHERE token <> '<*>' GROUP BY ALL HAVING sum(n_texts) >= 3
), templates AS (
    SELECT masked, '= ' || masked AS grp FROM forms WHERE 2 * fixed >= n
    UNION ALL
    SELECT masked, '~ ' || leaf || ' ' || string_agg(place || ':' || token, ' ' ORDER BY place)
    FROM fields SEMI JOIN constant USING (leaf, place, token) GROUP BY leaf, masked, n HAVING 10 * count(*) >= 7 * n
    UNION ALL
    SELECT masked, '? ' || place || ' ' || array_to_string(list_concat(parts[:place - 1], parts[place + 1:]), ' ')
    FROM fields WHERE place > 3 AND token <> '<*>' AND 10 * (fixed - 1) >= 7 * n
), hits AS (
    SELECT r, i, doc_id, text, grp, 3 AS needed FROM held JOIN templates USING (masked)
    UNION ALL
    SELECT r, i, doc_id, text, '" ' || literal, CASE WHEN n < 5 THEN 10 WHEN n < 10 THEN 3 ELSE 2 END FROM held
), groups AS (
    SELECT grp, min(doc_id) AS first FROM hits GROUP BY 1 HAVING count(DISTINCT text) >= any_value(needed)
), dropped AS (
    SELECT DISTINCT r, i FROM hits JOIN groups USING (grp) WHERE doc_id IS DISTINCT FROM first
), cleaned AS (
    SELECT r, doc_id, CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END AS text
    FROM docs LEFT JOIN (
        SELECT r, string_agg(line, chr(10) ORDER BY i) AS kept FROM placed ANTI JOIN dropped USING (r, i) GROUP BY 1
    ) USING (r)
)
SELECT doc_id, len(string_split(text, chr(10))) AS n_lines_kept, length(text) AS n_chars_kept,
    md5(text) AS text_md5 FROM cleaned"""

# Stretches of matching words per lag; those inside a stretch of a smaller lag do not have their smallest period.
ORACLES["op11_diagonal_runs"] = rf"""
WITH {CRC32}, docs AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS given,
        xor(list_reduce(list_prepend(4294967295::BIGINT,
                [('0x' || h)::BIGINT FOR h IN regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, ''))), '..')]),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
    FROM documents, crc_step
), cut AS (
    SELECT *, len(given) AS n, h // 10 AS g, CASE WHEN len(given) > 0 THEN (h // 10) % len(given) END AS a FROM docs
), said AS (
    SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
        THEN [given[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END] FOR i IN range(n)]
        ELSE given END AS words FROM cut
), word AS (
    SELECT r, n, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM said
), matched AS (
    SELECT x.r, x.i, x.i - y.i AS q FROM word x JOIN word y ON x.r = y.r AND x.word = y.word AND y.i < x.i
    WHERE 4 * (x.i - y.i) <= x.n
), islands AS (
    SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM matched
), stretches AS (
    SELECT r, q, min(i) - q AS s, count(*) + q AS k FROM islands GROUP BY r, q, island
    HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
    SELECT * FROM stretches x WHERE NOT EXISTS (
        SELECT 1 FROM stretches y WHERE y.r = x.r AND y.q < x.q AND y.s <= x.s AND y.s + y.k >= x.s + x.k)
), written AS (
    SELECT r, count(*) AS n_runs, string_agg(s || ',' || k || ',' || q || chr(10), '' ORDER BY s, q) AS lines
    FROM runs GROUP BY r
), best AS (
    SELECT r, s, k, q FROM runs x WHERE NOT EXISTS (
        SELECT 1 FROM runs y WHERE y.r = x.r AND (y.k * x.q > x.k * y.q
            OR y.k * x.q = x.k * y.q AND (y.s < x.s OR y.s = x.s AND y.q < x.q)))
), collapsed AS (
    SELECT r, string_agg(word, ' ' ORDER BY i) AS words FROM word w WHERE NOT EXISTS (
        SELECT 1 FROM runs x WHERE x.r = w.r AND w.i >= x.s + x.q AND w.i < x.s + x.k) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, k AS length, q AS period, 1000 * k // q AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed.words, '')) AS collapsed_sha256
FROM said LEFT JOIN written USING (r) LEFT JOIN best USING (r) LEFT JOIN collapsed USING (r)"""

ORACLES["op12_pipelined_search"] = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), items AS (
    SELECT row_number() OVER () AS i, item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark
), asked AS (
    SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(terms) AS term FROM items) GROUP BY ALL
), totals AS (
    SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM docs WHERE len(terms) > 0
), postings AS (
    SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs)
    GROUP BY ALL
), weights AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM postings, totals GROUP BY term, n_docs
), scored AS (
    SELECT i, item_id, r, doc_id,
        sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM asked JOIN postings USING (term) JOIN weights USING (term), totals GROUP BY ALL
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST, r) AS rank
    FROM scored WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20"""
