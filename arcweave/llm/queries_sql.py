"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from arcweave.llm.license_scan import TEMPLATES
from arcweave.llm.secret_scan import MORE_RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WHITE = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

OP2 = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
numbered AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM split),
keyed AS (SELECT doc_id, line, pos, translate(trim(line, {_WHITE}), '{_UPPER}', '{_LOWER}') AS line_key FROM numbered),
frequent AS (SELECT line_key, max(doc_id) AS last_doc FROM keyed WHERE length(line_key) >= 40
             GROUP BY line_key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.doc_id, k.line, k.pos, f.line_key IS NOT NULL AND k.doc_id < f.last_doc AS gone
           FROM keyed k LEFT JOIN frequent f ON k.line_key = f.line_key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP6 = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) END) AS g FROM split),
sets AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM grams),
sizes AS MATERIALIZED (SELECT d.doc_id, count(s.g) AS n FROM documents d LEFT JOIN sets s ON s.doc_id = d.doc_id GROUP BY d.doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS low FROM documents
  UNION
  SELECT e.b, r.low FROM reach r JOIN both_ways e ON e.a = r.node WHERE r.low < e.b)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, min(r.low) AS component_id
FROM sizes s JOIN reach r ON r.node = s.doc_id GROUP BY 1, 2
"""

_WORD = r"[^\x20\x09-\x0D]+"

# Every window that shares a shingle with an item is compared exactly; there are no fingerprints.
OP7 = f"""
WITH dw AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') AS w FROM documents),
iw AS MATERIALIZED (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') AS w FROM benchmark),
ig AS MATERIALIZED (SELECT item, item_id, len(w) AS words, g, count(*) AS c FROM (
  SELECT item, item_id, w, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS g FROM iw WHERE len(w) >= 5)
  GROUP BY ALL),
dg AS (SELECT doc_id, len(w) AS doc_words, i - 1 AS pos, array_to_string(list_slice(w, i, i + 4), ' ') AS g
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw WHERE len(w) >= 5)),
hit AS (SELECT doc_id, item, item_id, pos, g, c, words, doc_words, least(words, doc_words) - 4 AS width FROM dg JOIN ig USING (g)),
placed AS (SELECT *, unnest(range(greatest(0, pos - width + 1), least(pos, doc_words - 4 - width) + 1)) AS start_word FROM hit),
counted AS (SELECT doc_id, item, item_id, start_word, words, doc_words, width, g, least(count(*), c) AS m FROM placed
  GROUP BY doc_id, item, item_id, start_word, words, doc_words, width, g, c),
summed AS (SELECT doc_id, item, item_id, start_word, words, doc_words, width, CAST(sum(m) AS BIGINT) AS shared FROM counted GROUP BY ALL),
scored AS (SELECT *, shared / (width + words - 4 - shared) AS similarity FROM summed),
long_items AS (SELECT doc_id, item_id, similarity, start_word, least(words, doc_words) AS n_words FROM scored WHERE similarity >= 0.8
  QUALIFY row_number() OVER (PARTITION BY doc_id, item ORDER BY similarity DESC, start_word) = 1),
short_items AS (SELECT doc_id, item_id, CAST(1 AS DOUBLE) AS similarity, min(i) - 1 AS start_word, any_value(len(v)) AS n_words
  FROM (SELECT doc_id, item, item_id, dw.w AS w, iw.w AS v, unnest(range(1, len(dw.w) - len(iw.w) + 2)) AS i FROM dw, iw WHERE len(iw.w) BETWEEN 1 AND 4)
  WHERE list_slice(w, i, i + len(v) - 1) = v GROUP BY doc_id, item, item_id)
SELECT doc_id, item_id, similarity, CAST(start_word AS BIGINT) AS start_word, CAST(n_words AS BIGINT) AS n_words
FROM (SELECT * FROM long_items UNION ALL SELECT * FROM short_items)
"""


def _prior(rule: str) -> str:
    """Mean and weight of the beta prior of a host rule; the weight is null where hosts vary no more than by chance."""
    mean, k, n = f"(sum(fails_{rule}) / sum(host_docs))", "(count(*) - 1)", "sum(host_docs)"
    free = f"({n} - sum(CAST(host_docs AS DOUBLE) * host_docs) / {n} - {k})"
    spread = f"(sum(fails_{rule} * fails_{rule} / host_docs) - sum(fails_{rule}) * sum(fails_{rule}) / {n})"
    inside = f"(({spread} - {mean} * (1 - {mean}) * {k}) / ({mean} * (1 - {mean}) * {free}))"
    known = f"{mean} > 0 AND {mean} < 1 AND {free} > 0"
    return f"{mean} AS mean_{rule}, CASE WHEN {known} THEN CASE WHEN {inside} > 0 THEN greatest(1 / {inside} - 1, 0) END END AS weight_{rule}"


def _rate(rule: str) -> str:
    return f"CASE WHEN weight_{rule} IS NULL THEN mean_{rule} ELSE (fails_{rule} + mean_{rule} * weight_{rule}) / (host_docs + weight_{rule}) END"


_RULES = ("base", "symbols", "dup_lines", "word_length")
_VERDICTS = f"""
WITH words AS (SELECT doc_id, {{host}} AS source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
triples AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS pos, w FROM words WHERE len(w) >= 3),
windows AS (SELECT doc_id, pos, array_to_string(list_slice(w, pos, pos + 2), ' ') AS win FROM triples),
twice AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows) WHERE c >= 2),
covered AS (SELECT doc_id, pos AS p FROM twice UNION SELECT doc_id, pos + 1 FROM twice UNION SELECT doc_id, pos + 2 FROM twice),
repeats AS (SELECT doc_id, count(*) AS n_repeat_words FROM covered GROUP BY doc_id),
split AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM words),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM split
          WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
m AS (SELECT x.doc_id, x.source, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
      FROM words x LEFT JOIN lines l ON l.doc_id = x.doc_id LEFT JOIN repeats r ON r.doc_id = x.doc_id),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
        10 * n_symbols > n_words AS f_symbols, 10 * n_dup_lines > 3 * n_lines AS f_dup_lines,
        (word_chars < 2 * n_words OR word_chars > 14 * n_words) AS f_word_length FROM m),
hosts AS (SELECT source, count(*) AS host_docs, sum(base_failed::BIGINT) AS fails_base, sum(f_symbols::BIGINT) AS fails_symbols,
            sum(f_dup_lines::BIGINT) AS fails_dup_lines, sum(f_word_length::BIGINT) AS fails_word_length FROM f GROUP BY source),
prior AS (SELECT {", ".join(map(_prior, _RULES))} FROM hosts),
judged AS (SELECT source, {" AND ".join(f"{_rate(r)} <= 0.5" for r in _RULES)} AS host_ok
           FROM hosts, prior)
SELECT {{columns}} FROM f JOIN judged j ON f.source IS NOT DISTINCT FROM j.source
"""
OP8 = _VERDICTS.format(host="source", columns="doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_ok AS kept")
HOSTS_BY_LENGTH = _VERDICTS.format(host="CAST(length(CAST(n_chars AS VARCHAR)) AS VARCHAR)", columns="doc_id, f.source AS host, host_ok, NOT base_failed AND host_ok AS kept")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEMPLATE_ROWS = ", ".join(f"({i}, {_quoted(name)}, {_quoted(text)})" for i, (name, text) in enumerate(TEMPLATES))
_NORMAL = r"string_split(trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
OP1 = f"""
WITH given(template, license, text) AS (VALUES {_TEMPLATE_ROWS}),
tw AS (SELECT template, license, {_NORMAL.format("text")} AS w FROM given),
tc AS (SELECT *, greatest(16, CAST(2 ** ceil(log2(len(w))) AS BIGINT)) AS size_class FROM tw),
tg AS (SELECT DISTINCT template, license, size_class, array_to_string(list_slice(w, i, i + 4), ' ') AS g
       FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM tc)),
tn AS (SELECT template, count(*) AS n FROM tg GROUP BY template),
dw AS (SELECT doc_id, {_NORMAL.format("coalesce(text, '')")} AS w FROM documents),
dg AS (SELECT doc_id, i - 1 AS pos, array_to_string(list_slice(w, i, i + 4), ' ') AS g
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw WHERE len(w) >= 5)),
hit AS (SELECT doc_id, template, license, g, unnest([pos // size_class, pos // size_class - 1]) AS win FROM dg JOIN tg USING (g)),
held AS (SELECT doc_id, template, license, win, count(DISTINCT g) AS c FROM hit WHERE win >= 0 GROUP BY 1, 2, 3, 4)
SELECT doc_id, license, max(c / n) AS containment FROM held JOIN tn USING (template) WHERE c / n >= 0.8 GROUP BY 1, 2
"""


# The base kinds are written out here, apart from the rules of the operator: (name, expression, group, least).
_KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    *((r.name, r.pattern, r.group, r.least) for r in MORE_RULES),
]


def _matches(number: int, pattern: str, group: int, least: int) -> str:
    r = _quoted(pattern)
    return (f"SELECT doc_id, {number} AS kind, regexp_extract_all(t, {r}) AS m, string_split_regex(t, {r}) AS g, "
            f"regexp_extract_all(t, {r}, {group}) AS v, {least} AS least FROM docs")


_NAMES = "[" + ", ".join(_quoted(name) for name, *_ in _KINDS) + "]"
OP9 = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_matches(i, *rest) for i, (_, *rest) in enumerate(_KINDS))}),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
placed AS (SELECT doc_id, kind, v[i] AS v, least,
    CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s,
    length(m[i]) AS n FROM each),
good AS (SELECT doc_id, kind, s, {_NAMES}[kind + 1] || ':' || s || ':' || (s + n) AS shown FROM placed WHERE length(v) >= least),
per AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS b, count(*) FILTER (WHERE kind = 2) AS c,
    string_agg(shown, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS base, string_agg(shown, ',' ORDER BY s, kind) AS spans FROM good GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN per p ON p.doc_id = d.doc_id
"""


# DuckDB has no base32: five bits at a time are read from the digest's bit string.
OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i:
           lpad(CAST(bin(strpos('0123456789abcdef', substr(hex, i, 1)) - 1) AS VARCHAR), 4, '0')), '') AS b FROM p),
coded AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST(16 * CAST(substr(b, 5 * j + 1, 1) AS INT) + 8 * CAST(substr(b, 5 * j + 2, 1) AS INT) + 4 * CAST(substr(b, 5 * j + 3, 1) AS INT)
             + 2 * CAST(substr(b, 5 * j + 4, 1) AS INT) + CAST(substr(b, 5 * j + 5, 1) AS INT) AS INT), 1)), '') AS digest FROM bits),
newest AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS first_page FROM coded)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_page THEN NULL ELSE first_page END AS refers_to
FROM newest
"""


def _escaped(column: str) -> str:
    out = f"replace({column}, chr(92), chr(92) || chr(92))"
    for control in ("<s>", "</s>", "[INST]", "[/INST]"):
        out = f"replace({out}, '{control}', '{control[0]}' || chr(92) || '{control[1:]}')"
    return out


OP3 = f"""
WITH rows_in AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
shown AS (SELECT *, length('<s>[INST]' || {_escaped("role")} || '[/INST]' || {_escaped("text")} || '</s>') AS chars FROM rows_in)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""
