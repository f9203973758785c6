"""SQL for DuckDB that answers some of the queries in another way; see ``queries``."""

from __future__ import annotations

#: The contract's words; DuckDB's patterns know all of Unicode.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8, four bits at a time, the lower half of each byte first."""
    table = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    halves = f"list_transform(string_split(regexp_replace(hex(encode({text})), '(.)(.)', '\\2\\1', 'g'), ''), lambda h: CAST(strpos('0123456789ABCDEF', h) - 1 AS BIGINT))"
    last = f"list_reduce(list_filter({halves}, lambda h: h >= 0), lambda c, h: xor(c >> 4, CAST({table} AS BIGINT[])[xor(c & 15, h) + 1]), 4294967295::BIGINT)"
    return f"CASE WHEN {text} = '' THEN 0 ELSE xor({last}, 4294967295) END"


def sharding(seed: str, rounds: int, n_shards: int) -> str:
    """Row numbers by doc_id, taken through the rounds one by one until they land below the number of rows."""
    return f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id) - 1 AS x, count(*) OVER () AS n FROM documents
        ), r AS (
            SELECT n AS n_rows, CAST(ceil(sqrt(n)) AS BIGINT) AS a, CAST(ceil(n / ceil(sqrt(n))) AS BIGINT) AS b FROM (SELECT DISTINCT n FROM d)
        ), walk(doc_id, step, u, v) AS (
            SELECT doc_id, 0, x // b, x % b FROM d, r
            UNION ALL
            SELECT doc_id, CASE WHEN step = {rounds} THEN 0 ELSE step + 1 END, CASE WHEN step = {rounds} THEN u ELSE v END,
                   CASE WHEN step = {rounds} THEN v ELSE (u + CAST('0x' || substr(md5('{seed}:' || step || ':' || v), 1, 15) AS BIGINT)) % CASE step % 2 WHEN 0 THEN a ELSE b END END
            FROM walk, r WHERE step < {rounds} OR u * b + v >= n_rows
        )
        SELECT d.doc_id, CAST(strlen(text) + 8 AS BIGINT) AS size, CAST({crc32("text")} AS BIGINT) AS text_crc32, 'rows' AS law, CAST((u * b + v) % {n_shards} AS INT) AS shard,
               CAST((u * b + v) // {n_shards} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
        FROM d JOIN walk USING (doc_id), r WHERE step = {rounds} AND u * b + v < n_rows
    """


#: Stretches of equal words at each distance; those that a run of smaller period holds are left out.
PERIODIC_RUNS = f"""
    WITH t AS (
        SELECT doc_id, {WORDS} AS w, {crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents
    ), d AS (
        SELECT doc_id, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS parts, w FROM t
    ), o AS (
        SELECT doc_id, n, a, 1 + (n - a) // parts AS p, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d
    ), x AS (
        SELECT o.doc_id, o.n, o.i, coalesce(s.word, o.word) AS word FROM o LEFT JOIN o s ON s.doc_id = o.doc_id AND s.i = o.a + (o.i - o.a) % o.p AND o.i >= o.a
    ), m AS (
        SELECT l.doc_id, l.i, r.i - l.i AS q FROM x l JOIN x r ON r.doc_id = l.doc_id AND r.word = l.word AND r.i > l.i AND (r.i - l.i) * 4 <= l.n
    ), g AS (
        SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m
    ), c AS (
        SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)
    ), runs AS (
        SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c s WHERE s.doc_id = c.doc_id AND s.q < c.q AND s.start <= c.start AND s.start + s.length >= c.start + c.length)
    ), k AS (
        SELECT x.doc_id, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = x.doc_id AND x.i >= r.start + r.q AND x.i < r.start + r.length)) AS kept
        FROM x GROUP BY x.doc_id
    ), s AS (
        SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed, first({{'s': start, 'l': length, 'q': q}} ORDER BY length DESC, start, q) AS best
        FROM runs GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period, CAST(1000 * best.l // best.q AS BIGINT) AS exponent_milli,
           sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
    FROM d LEFT JOIN s USING (doc_id) LEFT JOIN k USING (doc_id)
"""

LEXICAL_SEARCH = f"""
    WITH t AS (
        SELECT doc_id, unnest({TERMS}) AS term FROM documents
    ), tf AS (
        SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL
    ), d AS (
        SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id
    ), c AS (
        SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d
    ), w AS (
        SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY term, docs
    ), m AS (
        SELECT doc_id, 100 - 50 + (50 * n * docs) // terms AS m FROM d, c
    ), q AS (
        SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark
    ), s AS (
        SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
        FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id
    ), r AS (
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0
    )
    SELECT * FROM r WHERE rank <= 50
"""
