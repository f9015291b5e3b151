"""DuckDB SQL for the operators on secrets and conversations."""

from __future__ import annotations

from .secrets import ASSIGN, BASE, BINS, ENCODINGS, KINDS, LEAST_BITS, SURE, TOKEN

SPACES = r"[\x20\x09-\x0D]"
CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, s: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, CAST(i AS BIGINT))) AS crc"
ORDER = "turn NULLS FIRST, role, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text)"


def crc32(key: str) -> str:
    return f"xor(list_reduce(list_transform(string_split({key}, ''), lambda x: CAST(unicode(x) AS BIGINT)), lambda c, b: xor(crc[CAST((xor(c, b) & 255) + 1 AS INT)], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295)"


# --- op11 -------------------------------------------------------------------------------------------------------------


def _matches(pattern: str) -> str:
    """start, end and match of all matches in text."""
    quoted = pattern.replace("'", "''")
    found, apart = f"regexp_extract_all(text, '{quoted}')", f"string_split_regex(text, '{quoted}')"
    return f"""SELECT place, upto - length(m) AS a, upto AS b, m FROM (SELECT place, unnest(m) AS m, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))))) AS upto
        FROM (SELECT place, {found} AS m, {apart} AS p FROM docs) WHERE len(m) > 0)"""


def _erfc(z: str) -> str:
    fixed = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    t = f"(1 / (1 + ({z}) / 2))"
    out = f"({fixed[-1]})"
    for c in fixed[-2::-1]:
        out = f"({out} * {t} + ({c}))"
    return f"({t} * exp({out} - ({z}) * ({z})))"


def _secrets() -> str:
    classes = ", ".join(f"({e}, '{''.join(c)}', CAST({len(''.join(c))} AS DOUBLE), {[len(x) for x in c]}, {[sum(map(len, c[:i])) + 1 for i in range(len(c))]}, '{'L' * (len(''.join(c)) // 2)}{'H' * (len(''.join(c)) // 2)}')" for e, c in enumerate(ENCODINGS))
    filters = (f"length(regexp_extract(m, '{ASSIGN.replace(chr(39), chr(39) * 2)}', 2)) >= 8", "true", "true")
    base = " UNION ALL ".join(f"SELECT place, a, {rank} AS r, b FROM ({_matches(pattern)}) WHERE {filters[rank]}" for rank, (_, pattern) in enumerate(BASE))
    half = lambda z: f"CASE WHEN {z} >= 0 THEN {_erfc(f'abs({z}) / sqrt(2)')} / 2 ELSE 1 - {_erfc(f'abs({z}) / sqrt(2)')} / 2 END"
    nats = lambda p: f"-ln(greatest({p}, 1e-300))"
    kinds = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    changes = lambda pair: f"(length(h) - length(replace(h, '{pair}', ''))) / 2"
    return f"""
        WITH docs AS (SELECT row_number() OVER () AS place, doc_id, coalesce(text, '') AS text FROM documents),
        base AS ({base}),
        enc(e, alphabet, k, sizes, starts, halves) AS (VALUES {classes}),
        token AS (SELECT row_number() OVER () AS id, place, a, b, rtrim(m, '=') AS t FROM ({_matches(TOKEN)})),
        met AS (SELECT id, place, a, b, t, length(t) AS n, enc.* FROM token JOIN enc ON translate(t, alphabet, '') = '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY e) = 1),
        shape AS (SELECT *, list_transform(string_split(alphabet, ''), lambda c: CAST(n - length(replace(t, c, '')) AS DOUBLE)) AS counts, translate(t, alphabet, halves) AS h,
                  list_sum(list_transform(range(1, n), lambda i: (instr(alphabet, t[i]) - (k + 1) / 2) * (instr(alphabet, t[i + 1]) - (k + 1) / 2))) AS lag FROM met WHERE n >= ceil({LEAST_BITS} / log2(k))),
        stat AS (SELECT *, list_sum(list_transform(counts, lambda v: v * v)) * k / n - n AS symbols, {changes('LH')} + {changes('HL')} AS turns, len(sizes) - 1 AS f,
                 list_sum(list_transform(range(1, len(sizes) + 1), lambda i: pow(list_sum(counts[starts[i]:starts[i] + sizes[i] - 1]) - n * sizes[i] / k, 2) / (n * sizes[i] / k))) AS classes FROM shape),
        z AS (SELECT *, (symbols - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n) AS z1, CASE WHEN f > 0 THEN (pow(classes / f, 1 / 3) - 1 + 2 / (9 * f)) / sqrt(2 / (9 * f)) END AS z2,
              abs(turns - (n - 1) / 2) / sqrt((n - 1) / 4) AS z3, abs(lag) / ((k * k - 1) / 12 * sqrt(n - 1)) AS z4 FROM stat),
        x AS (SELECT *, {nats(half('z1'))} + CASE WHEN f > 0 THEN {nats(half('z2'))} ELSE 0 END + {nats(_erfc('z3 / sqrt(2)'))} + {nats(_erfc('z4 / sqrt(2)'))} AS x FROM z),
        p AS (SELECT place, a, b, e, CAST(floor(log2(n)) AS INT) AS size, exp(-x) * (1 + x + x * x / 2 + CASE WHEN f > 0 THEN x * x * x / 6 ELSE 0 END) AS p FROM x),
        c AS (SELECT e, size, least(floor(p * {BINS}), {BINS - 1}) AS bin, count(*) AS n FROM p GROUP BY ALL),
        s AS (SELECT e, size, sum(n) AS n FROM c GROUP BY ALL),
        u AS (SELECT s.e, s.size, c.bin, sum(c.n) AS n FROM s JOIN c ON c.e = s.e AND (s.n < 50 OR c.size = s.size) GROUP BY ALL),
        j AS (SELECT e, size, j, coalesce(sum(n) FILTER (bin >= j), 0) AS above, coalesce(sum(n) FILTER (bin >= {SURE}), 0) * {BINS / (BINS - SURE)} AS random FROM u, range({SURE + 1}) AS r(j) GROUP BY ALL),
        l AS (SELECT e, size, min(j) FILTER (j = {SURE} OR above - random * ({BINS} - j) / {BINS} <= 0.05 * above) / {BINS} AS least FROM j GROUP BY ALL),
        spans AS (SELECT * FROM base UNION ALL SELECT place, a, {len(BASE)}, b FROM p JOIN l ON l.e = p.e AND l.size = p.size WHERE p >= least),
        told AS (SELECT place, {', '.join(f"count(*) FILTER (r = {r}) AS n_{k}" for r, (k, _) in enumerate(BASE))}, string_agg({kinds}[r + 1] || ':' || a || ':' || b, ',' ORDER BY a, r) AS spans,
                 string_agg({kinds}[r + 1] || ':' || a || ':' || b, ',' ORDER BY a, r) FILTER (r < {len(BASE)}) AS base FROM spans GROUP BY place)
        SELECT doc_id, {', '.join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k, _ in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN told USING (place)
    """


# --- op12 -------------------------------------------------------------------------------------------------------------


def _way(state: str, cost: str, letter: str, turn: str | None = None) -> str:
    """A state's cost, audit and turns after one more edit."""
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {f'list_append({state}.t, {turn})' if turn else f'{state}.t'}}}"


def _repair() -> str:
    never = "{'c': CAST(1099511627776 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}"
    kept = lambda state, kind: f"CASE WHEN kind = '{kind}' AND NOT must THEN {_way(state, 'late', 'K', "role || ':' || text")} ELSE {never} END"
    renamed = lambda state, role: f"CASE WHEN NOT must THEN {_way(state, '2 + late', 'R', f"'{role}:' || text")} ELSE {never} END"
    inserted = lambda state, role: _way(state, "2", "I", f"'{role}:'")
    start = f"CAST({{'c': 0, 'a': '', 't': []}} AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]))"
    return rf"""
        WITH RECURSIVE crc AS ({CRC_TABLE}),
        k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS harm FROM conversations, crc),
        d AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE WHEN harm = 1 THEN '' WHEN harm = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN harm = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE harm <> 0),
        n AS (SELECT conv_id, turn, role, text, left(role, 1) AS kind, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS before, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?]{SPACES}*\z') AS cut
              FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY {ORDER})),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM n),
        f AS (SELECT *, blank OR again AS must, CASE WHEN cut AND NOT blank AND NOT again THEN 1 ELSE 0 END AS late FROM o),
        e AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, CAST(sum(late) AS BIGINT) AS truncated,
                count(*) FILTER (before || kind NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
        s AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, {start} AS s0, {never} AS s1, {inserted('x', 'user').replace('x.', f'{start}.')} AS s2, {{'c': CAST(4 AS BIGINT), 'a': 'II', 't': ['user:', 'assistant:']}} AS s3 FROM e
              UNION ALL
              SELECT conv_id, i, q0, q1, r2, least(q3, {inserted('r2', 'assistant')}) FROM (SELECT *, list_min([q2, {inserted('q0', 'user')}, {inserted('q1', 'user')}, {inserted('q3', 'user')}]) AS r2 FROM (
                SELECT s.conv_id, f.i, {_way('s0', '3', 'D')} AS q0, least({_way('s1', '3', 'D')}, {kept('s0', 's')}) AS q1,
                       list_min([{_way('s2', '3', 'D')}, {kept('s0', 'u')}, {kept('s1', 'u')}, {kept('s3', 'u')}, {renamed('s0', 'user')}, {renamed('s1', 'user')}, {renamed('s3', 'user')}]) AS q2,
                       list_min([{_way('s3', '3', 'D')}, {kept('s2', 'a')}, {renamed('s2', 'assistant')}]) AS q3
                FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1))),
        best AS (SELECT s.conv_id, least(s0, s3) AS x FROM s JOIN e ON e.conv_id IS NOT DISTINCT FROM s.conv_id AND e.n = s.i)
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               CAST(coalesce(x.c, 0) AS BIGINT) AS cost, coalesce(x.a, '') AS audit, sha256(coalesce(array_to_string(x.t, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
    """


# --- op13 -------------------------------------------------------------------------------------------------------------

TRIE = f"""
        WITH crc AS ({CRC_TABLE}),
        t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY {ORDER}) AS r, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text) AS said FROM t),
        c AS (SELECT conv_id, n, conv_id - conv_id % 20 AS base, {crc32('CAST(conv_id AS VARCHAR)')} % 4 AS h FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id), crc),
        q AS (SELECT c.conv_id, r AS depth, said, text FROM c JOIN o ON o.conv_id = c.base AND r <= h
              UNION ALL SELECT c.conv_id, least(c.h, coalesce(b.n, 0)) + r - c.h, said, text FROM c LEFT JOIN c b ON b.conv_id = c.base JOIN o ON o.conv_id = c.conv_id AND r > c.h),
        m AS (SELECT conv_id, depth, string_agg(said, ',') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix, len(list_filter(string_split_regex(text, '{SPACES}+'), lambda w: w <> '')) AS words FROM q
              UNION ALL SELECT conv_id, 0, '', 0 FROM c),
        w AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, prefix) AS owner, max(depth) OVER (PARTITION BY conv_id) AS length FROM m),
        v AS (SELECT owner, depth, count(*) AS n, any_value(words) AS words, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = length), '') AS ends FROM w GROUP BY owner, depth),
        u AS (SELECT v.*, w.owner AS parent FROM v LEFT JOIN w ON w.conv_id = v.owner AND w.depth = v.depth - 1),
        k AS (SELECT u.*, coalesce(x.k, 0) AS children FROM u LEFT JOIN (SELECT parent, depth - 1 AS depth, count(*) AS k FROM u WHERE parent IS NOT NULL GROUP BY ALL) x ON x.parent = u.owner AND x.depth = u.depth),
        s AS (SELECT w.owner, w.depth, count(*) FILTER (k.children = 0) AS leaves, sum((k.n - 1) * k.words) AS saved FROM k JOIN w ON w.conv_id = k.owner AND w.depth <= k.depth GROUP BY ALL)
        SELECT k.owner AS conv_id, CAST(k.depth AS BIGINT) AS depth, k.parent AS parent_conv_id, CAST(k.n AS BIGINT) AS n_convs, CAST(children AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
        FROM k JOIN s ON s.owner = k.owner AND s.depth = k.depth
    """

SQL = {"op11_secrets": _secrets(), "op12_repair": _repair(), "op13_trie": TRIE}
