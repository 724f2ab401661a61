"""DuckDB SQL of the numbered operators, where SQL can express them; worked out by brute force.

Files in a format of their own (4), trained models (9, 10), a tokenizer's merges (11) and what takes SQL minutes on small
tables (7, every window of every text) are left to tests.
"""

ORACLES: dict[str, str] = {}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_WORD = r"'[^\x20\x09-\x0D]+'"


def _components(nodes: str, node: str, links: str) -> str:
    """CTEs reached(a, b) and component(node, component) of symmetric links(a, b)."""
    return f"""reached(a, b) AS (
      SELECT {node}, {node} FROM {nodes}
      UNION SELECT reached.a, {links}.b FROM reached JOIN {links} ON reached.b = {links}.a
    ), component AS (SELECT a AS node, MIN(b) AS component_id FROM reached GROUP BY a)"""


_ASSIGN = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_ASSIGN += r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _found(kind: str, rank: int, pattern: str, keep: str = "TRUE") -> str:
    """Matches with their places: the pieces between them, and the matches before, add up."""
    return f"""
    SELECT doc_id, '{kind}' AS kind, {rank} AS rank, value, place AS start, place + length(value) AS stop FROM (
      SELECT doc_id, m[i] AS value, g2[i] AS part,
        list_sum(list_transform(g[1:i], lambda x: length(x))) + COALESCE(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS place
      FROM (
        SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g,
          {f"regexp_extract_all(text, '{pattern}', 1)" if kind == "assign" else "NULL::VARCHAR[]"} AS g2
        FROM documents WHERE regexp_matches(text, '{pattern}')
      ), UNNEST(range(1, len(m) + 1)) AS t(i)
    ) WHERE {keep}"""


# What the operator's module fixes, as RE2 writes it.
_ALLOWED = (
    "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    "(?i:example|placeholder|changeme|dummy|your[_-]|xxxx)",
    "(?i:abcdefghijkl)|0123456789",
    "^[^0-9]+$",
)
_CLASSES = (("0-9a-fA-F", 3.0), ("A-Z0-9", 3.5), ("a-z0-9", 3.5), ("A-Za-z0-9+/_=-", 4.0))


def _masked(allowed: str) -> str:
    """The candidate with spaces for what the pattern suppresses: matches and up to 48 characters around, within a piece."""
    near = "[^=/_]{0,48}"
    pattern = f"(?:{near}(?:{allowed})){{1,8}}{near}"
    spaced = (
        f"array_to_string(list_transform(range(1, len(string_split_regex(value, '{pattern}')) + 1), lambda i: "
        f"string_split_regex(value, '{pattern}')[i] || repeat(' ', COALESCE(length(regexp_extract_all(value, '{pattern}')[i]), 0))), '')"
    )
    return f"CASE WHEN regexp_matches(value, '{allowed}') THEN {spaced} ELSE value END"


def _class_runs(source: str, characters: str, least: float) -> str:
    """Runs of one class within what is left of the candidates, but for those that an allowed pattern matches."""
    pattern = f"[{characters}]{{24,}}"
    refused = " OR ".join(f"regexp_matches(part, '{a}')" for a in _ALLOWED)
    return f"""
    SELECT doc_id, start, {least} AS least, part, place FROM (
      SELECT doc_id, start, m[i] AS part,
        list_sum(list_transform(g[1:i], lambda x: length(x))) + COALESCE(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS place
      FROM (SELECT doc_id, start, regexp_extract_all(value, '{pattern}') AS m, string_split_regex(value, '{pattern}') AS g FROM {source}),
        UNNEST(range(1, len(m) + 1)) AS t(i)
    ) WHERE NOT ({refused})"""


_MASKS = ", ".join(
    f"left{i + 1} AS MATERIALIZED (SELECT doc_id, start, {_masked(a)} AS value FROM {f'left{i}' if i else 'candidate'})"
    for i, a in enumerate(_ALLOWED)
)

# Every window of every class, with its characters counted anew; a window is hot by whole units, as in the operator.
ORACLES["op1_secrets"] = f"""
WITH base AS ({_found("assign", 0, _ASSIGN, "length(part) >= 6")}
  UNION ALL {_found("access", 1, "AKIA[A-Z0-9]{16,}")}
  UNION ALL {_found("hex", 2, "[0-9a-f]{24,}")}
), candidate AS ({_found("entropy", 3, "[A-Za-z0-9+/_=-]{24,}")}
), {_MASKS}, runs AS ({" UNION ALL ".join(_class_runs(f"left{len(_ALLOWED)}", c, least) for c, least in _CLASSES)}
), windows AS (
  SELECT doc_id, start, least, beg, SUM(CAST(ROUND(n * log2(n) * 1048576) AS BIGINT)) AS units FROM (
    SELECT doc_id, start, least, place + i - 1 AS beg, part, substr(part, i + k, 1) AS c, COUNT(*) AS n
    FROM runs, UNNEST(range(1, length(part) - 22)) AS t(i), UNNEST(range(0, 24)) AS u(k) GROUP BY ALL
  ) GROUP BY doc_id, start, least, beg, part
), hot AS (
  SELECT *, SUM(CASE WHEN beg - before <= 24 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, start ORDER BY beg) AS run FROM (
    SELECT doc_id, start, beg, COALESCE(LAG(beg) OVER (PARTITION BY doc_id, start ORDER BY beg), -100) AS before
    FROM (SELECT DISTINCT doc_id, start, beg FROM windows WHERE units <= FLOOR(24 * (log2(24) - least) * 1048576)))
), spans AS (
  SELECT doc_id, kind, rank, start, stop FROM base UNION ALL
  SELECT doc_id, 'entropy', 3, start + MIN(beg), start + MAX(beg) + 24 FROM hot GROUP BY doc_id, start, run
)
SELECT doc_id, CAST(COUNT(*) FILTER (rank = 0) AS BIGINT) AS n_assign, CAST(COUNT(*) FILTER (rank = 1) AS BIGINT) AS n_access,
  CAST(COUNT(*) FILTER (rank = 2) AS BIGINT) AS n_hex,
  sha256(COALESCE(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3), '')) AS base_sha256,
  COALESCE(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank IS NOT NULL), '') AS spans
FROM documents LEFT JOIN spans USING (doc_id) GROUP BY doc_id"""

# The checksum goes through the bytes of a text by half bytes, low half first.
ORACLES["op3_shards"] = """
WITH d AS (
  SELECT doc_id, COALESCE(text, '') AS text, COALESCE(octet_length(encode(text)), 0) + 1 AS size,
    row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS place FROM documents
), half AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
  FROM (SELECT CAST(n AS BIGINT) AS n FROM range(16) AS r(n))
), digits AS (
  SELECT doc_id, place, size, list_transform(string_split(hex(encode(text)), ''), lambda c: CAST(strpos('0123456789ABCDEF', c) - 1 AS BIGINT)) AS h
  FROM d WHERE text <> ''
), sums AS (
  SELECT place, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h) + 1), lambda i: h[i + CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END])),
    lambda c, b: xor(c >> 4, t[CAST(xor(c, b) & 15 AS INTEGER) + 1])), 4294967295) AS crc
  FROM digits, half
), cut AS (
  SELECT *, CAST(LEAST(15, (2 * (SUM(size) OVER (ORDER BY place) - size) + size) * 16 // (2 * SUM(size) OVER ())) AS INTEGER) AS shard FROM d
)
SELECT doc_id, size, COALESCE(crc, 0) AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut LEFT JOIN sums USING (place)"""

ORACLES["op2_decontaminate"] = f"""
WITH d AS (SELECT doc_id, COALESCE(regexp_extract_all({_LOWER}, {_ALNUM}), []) AS words FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS words FROM benchmark WHERE text IS NOT NULL),
w AS (
  SELECT DISTINCT item_id, size, array_to_string(words[k:k + size - 1], ' ') AS gram
  FROM (SELECT *, LEAST(13, len(words)) AS size FROM i WHERE len(words) > 0), UNNEST(range(1, len(words) - size + 2)) AS t(k)
), g AS (
  SELECT doc_id, k, size, array_to_string(words[k:k + size - 1], ' ') AS gram
  FROM d, (SELECT DISTINCT size FROM w) AS s, UNNEST(range(1, len(words) - size + 2)) AS t(k)
), hit AS (SELECT doc_id, item_id, k, size FROM g JOIN w USING (size, gram)),
n AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM hit, UNNEST(range(k, k + size)) AS t(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(COALESCE(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(COALESCE(n_items, 0) AS BIGINT) AS n_items, sha256(COALESCE(names, '')) AS items_sha256,
  COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN items USING (doc_id)"""

ORACLES["op5_near_vectors"] = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v AS x JOIN v AS y
    ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.93
), {_components("embeddings", "vec_id", "links")},
n AS (SELECT a AS vec_id, COUNT(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(COALESCE(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN component ON vec_id = node LEFT JOIN n USING (vec_id)"""

ORACLES["op6_mix"] = f"""
WITH d AS (SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, {_WORD})), 0) AS size FROM documents),
s AS (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS cap,
    CAST([5, 2, 1][(ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w
  FROM (SELECT source, SUM(size) AS source_size FROM d GROUP BY source)
), levels AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY cap / w, source NULLS LAST) AS k,
    ((SELECT SUM(source_size) FROM s) - COALESCE(SUM(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / SUM(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s
), targets AS (
  SELECT source, source_size, LEAST(cap, w * (SELECT arg_min(level, k) FROM levels WHERE level <= cap / w)) AS target FROM levels
), placed AS (
  SELECT d.doc_id, d.size, CAST(source_size AS BIGINT) AS source_size, target,
    ROW_NUMBER() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS rank,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5(concat_ws(':', '6', d.source)), 1, 8) AS UBIGINT) / 4294967296.0::DOUBLE AS start
  FROM d JOIN targets ON d.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (floor(start + (rank + 1) * rate) - floor(start + rank * rate)) AS BIGINT) AS taken FROM placed"""

ORACLES["op8_near_duplicates"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, COALESCE(regexp_extract_all({_LOWER}, {_WORD}), []) AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[k:k + size - 1], ' ') AS gram
  FROM (SELECT *, LEAST(4, len(words)) AS size FROM d WHERE len(words) > 0), UNNEST(range(1, len(words) - size + 2)) AS t(k)
), n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS common FROM s AS x JOIN s AS y USING (gram) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
    JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)
), {_components("documents", "doc_id", "links")}
SELECT doc_id, CAST(COALESCE(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN component ON doc_id = node LEFT JOIN n USING (doc_id)"""


def _crc32(text: str) -> str:
    """The CRC-32 of a short ASCII text: each character is mixed in, then eight bits are shifted out."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda x: list_prepend(ascii(x)::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1])))"
    turn = "CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END"
    return f"xor(list_reduce(list_prepend(4294967295, {steps}), lambda c, b: {turn}), 4294967295)"


# Shortest edits row by row: the least of (cost, letters, lines so far) for each conversation, row and state.  Two ways
# to a state of equal cost are never one the beginning of the other, so the least letters so far stay the least.
ORACLES["op12_repair_conversations"] = rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
    {_crc32("COALESCE(conv_id::VARCHAR, ' ') || ':' || COALESCE(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    UNNEST(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM raw WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
), judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    role[1:1] || lead(role) OVER (PARTITION BY conv_id ORDER BY i)[1:1] AS pair
  FROM placed
), inserts(q, q1, cost, letters, lines) AS (
  VALUES (0, 0, 0, '', ''), (0, 2, 2, 'I', chr(10) || 'user:'), (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
    (1, 1, 0, '', ''), (1, 2, 2, 'I', chr(10) || 'user:'), (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
    (2, 2, 0, '', ''), (2, 3, 2, 'I', chr(10) || 'assistant:'), (3, 3, 0, '', ''), (3, 2, 2, 'I', chr(10) || 'user:')
), moves(letter, q1, initial, q2, cost, role) AS (
  VALUES ('D', 0, NULL, 0, 3, NULL), ('D', 1, NULL, 1, 3, NULL), ('D', 2, NULL, 2, 3, NULL), ('D', 3, NULL, 3, 3, NULL),
    ('K', 0, 's', 1, 0, NULL), ('K', 0, 'u', 2, 0, NULL), ('K', 1, 'u', 2, 0, NULL), ('K', 2, 'a', 3, 0, NULL),
    ('K', 3, 'u', 2, 0, NULL), ('R', 0, NULL, 2, 2, 'user'), ('R', 1, NULL, 2, 2, 'user'),
    ('R', 2, NULL, 3, 2, 'assistant'), ('R', 3, NULL, 2, 2, 'user')
), ways(conv_id, i, q, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, {{'cost': 0, 'letters': '', 'lines': ''}} FROM judged
  UNION ALL
  SELECT conv_id, i, q2, MIN(best) FROM (
    SELECT w.conv_id, j.i, m.q2, {{
      'cost': w.best.cost + n.cost + m.cost + CASE WHEN j.fault = 'truncated' AND m.letter <> 'D' THEN 1 ELSE 0 END,
      'letters': w.best.letters || n.letters || m.letter,
      'lines': w.best.lines || n.lines
        || CASE WHEN m.letter = 'D' THEN '' ELSE chr(10) || COALESCE(m.role, j.role) || ':' || j.text END}} AS best
    FROM ways AS w JOIN inserts AS n ON n.q = w.q JOIN moves AS m ON m.q1 = n.q1
    JOIN judged AS j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1
    WHERE (m.letter = 'D' OR j.fault NOT IN ('blank', 'duplicate')) AND (m.initial IS NULL OR m.initial = j.role[1:1])
  ) GROUP BY conv_id, i, q2
), totals AS (
  SELECT conv_id, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) AS n,
    COUNT(*) FILTER (fault = 'blank') AS blank, COUNT(*) FILTER (fault = 'duplicate') AS duplicate,
    COUNT(*) FILTER (fault = 'truncated') AS truncated, COUNT(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
), answers AS (
  SELECT conv_id, MIN(best) AS best FROM (
    SELECT w.conv_id, {{'cost': w.best.cost + n.cost, 'letters': w.best.letters || n.letters, 'lines': w.best.lines || n.lines}} AS best
    FROM ways AS w JOIN totals AS t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.i
    JOIN inserts AS n ON n.q = w.q WHERE n.q1 IN (0, 3)
  ) GROUP BY conv_id
)
SELECT c.conv_id, COALESCE(t.gaps, 0)::BIGINT AS gaps, COALESCE(t.blank, 0)::BIGINT AS blank,
  COALESCE(t.duplicate, 0)::BIGINT AS duplicate, COALESCE(t.truncated, 0)::BIGINT AS truncated,
  COALESCE(t.illegal, 0)::BIGINT AS illegal, COALESCE(a.best.cost, 0)::BIGINT AS cost,
  COALESCE(a.best.letters, '') AS audit, sha256(COALESCE(a.best.lines[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c
LEFT JOIN totals AS t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN answers AS a ON a.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def _field(value: str) -> str:
    return f"COALESCE(strlen(({value})::VARCHAR) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(v) for v in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _tree(name: str, leaves: str) -> str:
    """CTEs of the nodes (tree, level, i, n, h) above leaves (tree, i, n, h), and of what stands beside each."""
    return f"""{name}(tree, level, i, n, h) AS (
      SELECT tree, 0, i, n, h FROM {leaves}
      UNION ALL SELECT tree, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {name}
      WHERE n > 1 GROUP BY tree, level, i // 3, n
    ), {name}_beside AS (
      SELECT a.tree, a.level, a.i, COALESCE(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before,
        COALESCE(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
      FROM {name} AS a LEFT JOIN {name} AS b
        ON a.tree = b.tree AND a.level = b.level AND a.i // 3 = b.i // 3 AND a.i <> b.i
      WHERE a.n > 1 GROUP BY a.tree, a.level, a.i
    )"""


ORACLES["op13_merkle_manifest"] = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, {_leaf("text")} AS leaf,
    CASE WHEN {_crc32("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS changed
  FROM documents
), leaves AS (
  SELECT doc_id, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    COUNT(*) OVER (PARTITION BY tree) AS n, leaf AS h, changed FROM docs
), {_tree("lower_nodes", "leaves")}, subroots AS (
  SELECT 0 AS tree, tree AS i, COUNT(*) OVER () AS n, h FROM lower_nodes WHERE n = 1
), {_tree("upper_nodes", "subroots")}, climb(doc_id, tree, leaf, first, level, i, h, proof) AS (
  SELECT doc_id, tree, h, i, 0, i, changed, '' FROM leaves
  UNION ALL SELECT c.doc_id, c.tree, c.leaf, c.first, c.level + 1, c.i // 3, sha256(s.before || c.h || s.after), proof || s.before || s.after
  FROM climb AS c JOIN lower_nodes_beside AS s ON s.tree = c.tree AND s.level = c.level AND s.i = c.i
), finish(doc_id, tree, leaf, first, level, i, h, proof) AS (
  SELECT c.doc_id, c.tree, c.leaf, c.first, 0, c.tree, c.h, c.proof FROM climb AS c
  JOIN lower_nodes AS n ON n.tree = c.tree AND n.level = c.level AND n.i = c.i AND n.n = 1
  UNION ALL SELECT c.doc_id, c.tree, c.leaf, c.first, c.level + 1, c.i // 3, sha256(s.before || c.h || s.after), proof || s.before || s.after
  FROM finish AS c JOIN upper_nodes_beside AS s ON s.level = c.level AND s.i = c.i
)
SELECT f.doc_id, f.leaf, r.h AS subroot, n.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = n.h AS verified
FROM finish AS f JOIN upper_nodes AS n ON n.level = f.level AND n.n = 1 JOIN subroots AS r ON r.i = f.tree
"""
