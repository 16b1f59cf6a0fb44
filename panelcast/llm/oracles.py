"""The operators that SQL can express, for DuckDB, written from their definitions."""

from __future__ import annotations

SPACE = r"[^\x20\x09-\x0D]+"

# distinct three-word shingles of every document; pairs by shared shingles; components by reachability
OP3 = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACE}') AS w FROM documents
), sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words
), flat AS (
    SELECT doc_id, len(s) AS n, hash(unnest(s)) AS g FROM sets
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
    FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM shared WHERE 100 * common >= 85 * (na + nb - common)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least_id AS (
    SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least_id ON a = doc_id
"""

# every window of fifty words that two documents have, merged where windows overlap or touch
OP4 = rf"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACE}') AS w FROM documents WHERE text IS NOT NULL
), windows AS (
    SELECT doc_id, i - 1 AS start, hash(w[i:i + 49]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)
), repeated AS (
    SELECT DISTINCT doc_id, start FROM windows JOIN (SELECT g FROM windows GROUP BY g HAVING min(doc_id) < max(doc_id)) USING (g)
), marked AS (
    SELECT doc_id, start, CASE WHEN start - lag(start) OVER (PARTITION BY doc_id ORDER BY start) <= 50 THEN 0 ELSE 1 END AS fresh FROM repeated
), numbered AS (
    SELECT doc_id, start, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start) AS span FROM marked
), spans AS (
    SELECT doc_id, span, min(start) AS a, max(start) + 50 AS b FROM numbered GROUP BY ALL
)
SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_repeated_words, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM spans GROUP BY doc_id
"""

# CRC-32 by its bits: the table of a byte's eight steps, then one look-up per byte of the text
OP5 = """
WITH RECURSIVE bits AS (
    SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS step FROM range(256) t(i)
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8
), steps AS (
    SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8
), hexed AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, md5(coalesce(text, '')) AS digest FROM documents
), sized AS (
    SELECT doc_id, (length(h) // 2 + 1)::BIGINT AS size, ('0x' || substr(digest, 1, 15))::BIGINT AS k,
        xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
    FROM hexed, steps
), ahead AS (
    SELECT *, sum(size) OVER (ORDER BY k, doc_id) - size AS below, sum(size) OVER () AS total FROM sized
), placed AS (
    SELECT *, (16 * below // total)::INTEGER AS shard FROM ahead
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY k, doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard FROM placed
"""

OP6 = """
WITH RECURSIVE valid AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) ON a = vec_id
"""

# targets by repeated sharing; a document's draw from its MD5 digest, shifted per source
OP9 = rf"""
WITH RECURSIVE sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{SPACE}')), 0)::BIGINT AS size,
        ('0x' || substr(md5('20:' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS unit
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sized GROUP BY source
), rounds AS (
    SELECT 0 AS round, source, source_size, weight, false AS stopped FROM sources
    UNION ALL
    SELECT round + 1, source, source_size, weight, stopped OR rest * weight >= 3 * source_size * free FROM (
        SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (stopped) OVER (), 0) AS rest, sum(weight) FILTER (NOT stopped) OVER () AS free FROM rounds
    ) WHERE round < 60
), final AS (
    SELECT source, source_size, CASE WHEN stopped THEN (3 * source_size)::DOUBLE ELSE rest::BIGINT::DOUBLE * weight / free::BIGINT END AS target FROM (
        SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (stopped) OVER (), 0) AS rest, sum(weight) FILTER (NOT stopped) OVER () AS free FROM rounds WHERE round = 60
    )
), rates AS (
    SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM final
), draws AS (
    SELECT r.source, shift, abs(sum(CASE WHEN unit + shift / 32.0::DOUBLE - floor(unit + shift / 32.0::DOUBLE) < rate - floor(rate) THEN size ELSE 0 END)::BIGINT
        - (any_value(target) - floor(any_value(rate)) * any_value(source_size))) AS off
    FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source, range(32) t(shift) GROUP BY r.source, shift
), chosen AS (
    SELECT source, shift FROM draws QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, shift) = 1
)
SELECT doc_id, size, source_size, target,
    (size * (floor(rate) + CASE WHEN unit + shift / 32.0::DOUBLE - floor(unit + shift / 32.0::DOUBLE) < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source JOIN chosen c ON s.source IS NOT DISTINCT FROM c.source
"""

_CRC = """bits AS (
    SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS step FROM range(256) t(i)
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8
), steps AS (
    SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8
)"""


def _crc(text: str) -> str:
    """CRC-32 of a short text, beside the table ``steps``."""
    return f"""xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, length(hex(encode({text}))) // 2), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""


# states of the role pattern: 0 nothing yet, 1 after s, 2 after u, 3 after a; each with the cheapest
# (cost, edits, repaired lines) of what is left
_AFTER = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
_KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})


def _way(cost: str, letter: str, rest: str, line: str | None) -> str:
    lines = f"{rest}.b" if line is None else f"list_prepend({line}, {rest}.b)"
    return f"{{'c': ({cost} + {rest}.c)::BIGINT, 'a': '{letter}' || {rest}.a, 'b': {lines}}}"


def _consumed(q: int) -> str:
    kept = " ".join(f"WHEN '{x}' THEN {_way('stay', 'K', f's{to}', 'role || chr(58) || text')}" for x, to in _KEPT[q].items())
    to, role = _AFTER[q]
    changed = _way("3 + stay", "R", f"s{to}", f"'{role}:' || text")
    return f"list_min(list_filter([{_way('4', 'D', f's{q}', None)}, CASE WHEN free THEN CASE substr(role, 1, 1) {kept} END END, CASE WHEN free THEN {changed} END], lambda x: x IS NOT NULL)) AS t{q}"


def _inserted(q: int, rest: str) -> str:
    role = _AFTER[q][1]
    return f"list_min([t{q}, {_way('3', 'I', rest, f"'{role}:'")}])"


_END = ", ".join(f"{{'c': {c}::BIGINT, 'a': '{a}', 'b': {b}::VARCHAR[]}} AS s{q}" for q, (c, a, b) in enumerate(
    [(0, "", "[]"), (6, "II", "['user:', 'assistant:']"), (3, "I", "['assistant:']"), (0, "", "[]")]))
OP11 = rf"""
WITH RECURSIVE {_CRC}, keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), fated AS (
    SELECT conv_id, turn, role, text, {_crc('k')} % 20 AS fate FROM keyed, steps
), hurt AS (
    SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
    FROM fated WHERE fate <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
        lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) || substr(role, 1, 1) AS pair
    FROM hurt
), judged AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN again THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault
    FROM placed
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM judged GROUP BY conv_id
), best AS (
    SELECT conv_id, i, {_END} FROM placed WHERE i = n
    UNION ALL
    SELECT conv_id, i - 1, {_inserted(0, "u2")} AS s0, {_inserted(1, "u2")} AS s1, u2 AS s2, u3 AS s3 FROM (
        SELECT conv_id, i, t0, t1, {_inserted(2, "t3")} AS u2, {_inserted(3, "t2")} AS u3 FROM (
            SELECT b.conv_id, b.i, {", ".join(map(_consumed, range(4)))}
            FROM (SELECT *, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS stay, fault NOT IN ('blank', 'duplicate') AS free FROM judged) r
            JOIN best b ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i))
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(s0.c, 0) AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(array_to_string(s0.b, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = 0
"""

# levels of the trees of sources (z) and of the tree over them (y), as many as 3**LEVELS rows need
LEVELS = 12


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"


def _digest(text: str) -> str:
    return "sha256(" + " || ".join([*map(_field, ("doc_id", "source", "lang", "n_chars")), _field(text)]) + ")"


def _tree(name: str, by: str) -> str:
    """Level after level; a tree whose level is one node repeats it."""
    out = []
    for k in range(LEVELS):
        out.append(f"""{name}{k + 1} AS (
    SELECT {by}, ix // 3 AS ix, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY ix)) ELSE any_value(d) END AS d, ((any_value(n) + 2) // 3)::BIGINT AS n
    FROM {name}{k} GROUP BY {by}, ix // 3
)""")
    return ", ".join(out)


def _climb(start: str, name: str, by: str) -> str:
    """Siblings before and after a node's path on every level, and the fold of a tampered digest."""
    out, last = [], start
    for k in range(LEVELS):
        out.append(f"""{start}_{name}{k} AS (
    SELECT p.* EXCLUDE (ix, fold, proof), p.ix // 3 AS ix, p.proof || q.ahead || q.behind AS proof, CASE WHEN q.n > 1 THEN sha256(q.ahead || p.fold || q.behind) ELSE p.fold END AS fold
    FROM {last} p JOIN (
        SELECT x.{by}, x.ix, any_value(x.n) AS n, coalesce(string_agg(s.d, '' ORDER BY s.ix) FILTER (s.ix < x.ix), '') AS ahead,
            coalesce(string_agg(s.d, '' ORDER BY s.ix) FILTER (s.ix > x.ix), '') AS behind
        FROM {name}{k} x JOIN {name}{k} s ON s.{by} = x.{by} AND s.ix // 3 = x.ix // 3 GROUP BY x.{by}, x.ix
    ) q ON q.{by} = p.{by} AND q.ix = p.ix
)""")
        last = f"{start}_{name}{k}"
    return ", ".join(out)


OP13 = f"""
WITH RECURSIVE {_CRC}, digests AS (
    SELECT doc_id, source, {_digest('text')} AS leaf,
        CASE WHEN {_crc("coalesce(doc_id::VARCHAR, '')")} % 2 = 0 THEN {_digest("replace(text, chr(10), '')")} ELSE {_digest('text')} END AS hurt
    FROM documents, steps
), ranked AS (
    SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM digests
), leaves AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, hurt) - 1 AS ix, row_number() OVER () AS rid FROM ranked
), z0 AS (
    SELECT tree, ix, leaf AS d, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), {_tree('z', 'tree')}, y0 AS (
    SELECT 0 AS top, tree AS ix, d, count(*) OVER () AS n FROM z{LEVELS}
), {_tree('y', 'top')}, lower_path AS (
    SELECT rid, doc_id, leaf, tree, ix, hurt AS fold, '' AS proof FROM leaves
), {_climb('lower_path', 'z', 'tree')}, upper_path AS (
    SELECT rid, doc_id, leaf, tree, 0 AS top, tree AS ix, fold, proof FROM lower_path_z{LEVELS - 1}
), {_climb('upper_path', 'y', 'top')}
SELECT doc_id, leaf, z.d AS subroot, y.d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = y.d AS verified
FROM upper_path_y{LEVELS - 1} p JOIN z{LEVELS} z ON z.tree = p.tree, y{LEVELS} y
"""
