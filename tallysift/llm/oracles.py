"""SQL for the results that SQL can express."""

from tallysift.llm.quality_rules import RULES

WORD = r"[^\x20\x09-\x0D]+"


def rules_measured(docs: str = "documents") -> str:
    """CTEs down to ``measured``: the measures of every row of ``docs``."""
    return rf"""
    src AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS body FROM {docs}),
    toks AS (SELECT rid, regexp_extract_all(body, '{WORD}') AS w,
                    list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM src),
    wins AS (SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g
             FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM toks WHERE len(w) >= 3)),
    hits AS (SELECT rid, i FROM wins QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
    covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM hits, (VALUES (0), (1), (2)) t(k) GROUP BY rid),
    measured AS (
      SELECT src.*, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(length(body) - length(regexp_replace(body, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines,
             CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
      FROM src JOIN toks USING (rid) LEFT JOIN covered USING (rid))"""


def rules_judged(alpha: float = 0.05, delta: float = 0.05) -> str:
    """CTEs from ``measured`` to ``judged``."""
    share = alpha / len(RULES)
    cells = "\n UNION ALL ".join(
        f"SELECT lang_, '{r}' AS rule, {c} AS cut, count(*) AS n, count(*) FILTER (100 * {top} > {c} * {bottom}) AS k "
        f"FROM holdout GROUP BY lang_" for r, (top, bottom, grid) in RULES.items() for c in grid)
    bad = " OR ".join(
        f"coalesce(100 * {top} > (SELECT min(cut) FROM passed WHERE passed.lang_ = b.lang_ AND rule = '{r}') * {bottom}, false)"
        for r, (top, bottom, _) in RULES.items())
    return f"""
    based AS (SELECT *, coalesce(lang, '') AS lang_, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
              FROM measured),
    good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1),
    holdout AS (SELECT based.* FROM based JOIN good USING (doc_id) WHERE NOT base_failed),
    cells AS ({cells}),
    tails AS (SELECT *, CASE WHEN k >= n * {share} THEN 1 ELSE list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda j:
                exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({share}) + (n - j) * ln(1 - {share})))) END AS p
              FROM cells),
    passed AS (SELECT lang_, rule, cut FROM tails
               WHERE p <= {delta} / ((SELECT count(DISTINCT lang_) FROM holdout) * {len(RULES)})),
    judged AS (SELECT b.*, NOT base_failed AND NOT ({bad}) AS kept FROM based b)"""


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LATIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def contamination(docs: str = "documents") -> str:
    """CTEs down to ``judged``: hit words, items and verdict of every row of ``docs``."""
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
    iw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({lowered}, '{LATIN}') AS w FROM benchmark),
    pats AS (SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
             FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM iw WHERE len(w) > 0)),
    dw AS (SELECT row_number() OVER () AS rid, *, regexp_extract_all({lowered}, '{LATIN}') AS w FROM {docs}),
    wins AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
             FROM (SELECT rid, k, w, unnest(range(1, len(w) - k + 2)) AS i
                   FROM dw, (SELECT DISTINCT k FROM pats) WHERE len(w) >= k)),
    hits AS (SELECT rid, item, k, i FROM wins JOIN pats USING (k, g)),
    n_hits AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hits) GROUP BY rid),
    n_items AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
                FROM (SELECT DISTINCT rid, item FROM hits WHERE item IS NOT NULL) GROUP BY rid),
    judged AS (SELECT dw.*, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hits.n, 0) AS BIGINT) AS n_hit,
                      CAST(coalesce(n_items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
                      coalesce(n_hits.n, 0) > 0 AND 20 * coalesce(n_hits.n, 0) >= len(w) AS contaminated
               FROM dw LEFT JOIN n_hits USING (rid) LEFT JOIN n_items USING (rid))"""


BLANK = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op11_lexical_search": rf"""WITH dt AS (
          SELECT rid, doc_id, unnest(w) AS term, len(w) AS n FROM (
            SELECT row_number() OVER () AS rid, doc_id,
                   regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '{TERM}') AS w FROM documents)),
        tf AS (SELECT rid, doc_id, term, n, count(*) AS tf FROM dt GROUP BY ALL),
        size AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS total FROM (SELECT rid, any_value(n) AS n FROM dt GROUP BY rid)),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nd) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
              FROM tf, size GROUP BY term),
        iq AS (SELECT iid, item_id, term, count(*) AS c FROM (
                 SELECT iid, item_id, unnest(w) AS term FROM (
                   SELECT row_number() OVER () AS iid, item_id,
                          regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '{TERM}') AS w FROM benchmark)) GROUP BY ALL),
        s AS (SELECT iid, item_id, rid, doc_id,
                     CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // total)))) AS BIGINT) AS score
              FROM iq JOIN w USING (term) JOIN tf USING (term), size GROUP BY ALL)
        SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS r FROM s WHERE score > 0)
        WHERE r <= 20""",
    "op12_prefix_trie": """WITH t AS (
          SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) - 1 AS pos, g, b
          FROM (SELECT *, md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS g, strlen(coalesce(text, '')) AS b
                FROM conversations WHERE conv_id IS NOT NULL)),
        k AS (SELECT c, c - c % 5 AS base, CASE WHEN c % 5 = 0 THEN 0 ELSE CAST(crc AS BIGINT) % 9 END AS h
              FROM (SELECT DISTINCT c, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
                      range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(c AS VARCHAR)[i]) AS BIGINT))),
                      lambda a, x: list_reduce([xor(a, x), 1, 2, 3, 4, 5, 6, 7, 8], lambda v, i:
                        CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)) AS rest,
                      xor(rest, 4294967295) AS crc FROM t)),
        lead AS (SELECT k.c, t.pos, t.g, t.b FROM k JOIN t ON t.c = k.base WHERE k.c <> k.base AND t.pos < h),
        n_lead AS (SELECT k.c, k.h, count(l.c) AS n FROM k LEFT JOIN lead l ON l.c = k.c GROUP BY k.c, k.h),
        r AS (SELECT c, pos + 1 AS d, g, b FROM lead UNION ALL
              SELECT t.c, n + pos - h + 1, g, b FROM t JOIN n_lead ON n_lead.c = t.c WHERE pos >= h),
        p AS (SELECT c, d, b, string_agg(g, '') OVER (PARTITION BY c ORDER BY d) AS path FROM r
              UNION ALL SELECT c, 0, 0, '' FROM k),
        ending AS (SELECT c, max(d) AS d FROM p GROUP BY c),
        nodes AS (SELECT path, d, min(p.c) AS conv_id, count(*) AS n_convs, any_value(b) AS b,
                         coalesce(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (ending.d IS NOT NULL), '') AS ends
                  FROM p LEFT JOIN ending USING (c, d) GROUP BY path, d),
        kids AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
        below AS (SELECT a.path, sum((z.n_convs - 1) * z.b) AS saved, count(*) FILTER (kids.n IS NULL) AS n_leaves
                  FROM nodes a JOIN nodes z ON starts_with(z.path, a.path) LEFT JOIN kids ON kids.path = z.path GROUP BY a.path)
        SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(kids.n, 0) AS n_children,
               n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
        FROM nodes v JOIN below ON below.path = v.path LEFT JOIN kids ON kids.path = v.path
        LEFT JOIN nodes u ON v.d > 0 AND u.path = left(v.path, length(v.path) - 32)""",
    "op13_line_dedup": f"""WITH l AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
        x AS (SELECT rid, doc_id, s[i] AS line, i, {LOWERED.format(f"trim(s[i], {BLANK})")} AS key
              FROM (SELECT rid, doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM l)),
        f AS (SELECT key, min(doc_id) AS first FROM x WHERE length(key) >= 10 GROUP BY key),
        y AS (SELECT x.*, coalesce(first IS NOT NULL AND (doc_id IS NULL OR doc_id > first), false) AS gone FROM x LEFT JOIN f USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM y GROUP BY rid, doc_id""",
    "op10_perspectives": """WITH said AS (
          SELECT conv_id, CAST(floor(turn / 64) AS BIGINT) AS chunk, turn, coalesce(role, 'unknown') AS who,
                 replace(coalesce(text, ''), '<|', '<\\|') || '<|end|>' || chr(10) AS body FROM conversations),
        t AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, chunk ORDER BY turn NULLS FIRST, who, body) - 1) // 4096 AS part FROM said),
        p AS (SELECT DISTINCT conv_id, who AS participant FROM t WHERE who <> 'system'),
        v AS (SELECT t.*, participant, who = participant AS own,
                     CASE WHEN who = participant THEN '<|assistant|>' WHEN who = 'system' THEN '<|system|>'
                     ELSE '<|user:' || replace(replace(replace(who, '<|', '<\\|'), '|>', '|\\>'), chr(10), ' ') || '|>' END
                     || chr(10) AS head
              FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
        o AS (SELECT *, row_number() OVER w AS k, sum(length(head) + length(body)) OVER w - length(body) AS pos FROM v
              WINDOW w AS (PARTITION BY conv_id, participant, chunk, part ORDER BY turn NULLS FIRST, who, body
                           ROWS UNBOUNDED PRECEDING))
        SELECT conv_id, participant, chunk, part, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
               string_agg(head || body, '' ORDER BY k) AS rendered,
               coalesce(string_agg(CAST(CAST(pos AS BIGINT) AS VARCHAR) || ':' || length(body), ',' ORDER BY k) FILTER (own), '') AS mask
        FROM o GROUP BY conv_id, participant, chunk, part""",
    "op9_warc": """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        s AS (SELECT b, max(page_id) AS first FROM p WHERE octet_length(b) >= 1000 GROUP BY b HAVING count(*) > 1)
        SELECT page_id, CAST(octet_length(p.b) AS BIGINT) AS payload_bytes, sha1(p.b) AS payload_digest,
               CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM p LEFT JOIN s ON p.b = s.b""",
    "op8_decontaminate": f"""WITH {contamination()}
        SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM judged""",
    "op1_quality_rules": f"""WITH {rules_measured()}, {rules_judged()}
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged""",
}
