"""DuckDB SQL for the operators' queries, where SQL can express them."""

from __future__ import annotations

from paceline.llm.quality import BOILERPLATE

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"

_LINES = """
l AS (SELECT doc_id, line, pos FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents))
"""

OP8 = rf"""
WITH {_LINES},
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^{_SPACE}+', ''), '{_SPACE}+$', ''),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, coalesce(k.doc_id <> s.top, false) AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_PHRASES = "|".join(BOILERPLATE)
OP10 = rf"""
WITH {_LINES},
w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
judged AS (
  SELECT *, length(regexp_replace(line, '{_SPACE}', '', 'g')) AS chars, len(regexp_extract_all(line, '{_WORD}')) AS n,
         len(regexp_extract_all(line, '[#*$%&|<>]')) AS sym, len(regexp_extract_all(line, '[|»›·•→]')) AS bars FROM l),
ruled AS (
  SELECT *, sym * 10 > length(line) OR (contains(line, '!!') AND upper(line) = line AND length(line) >= 10)
         OR NOT regexp_matches(line, '[.,;:!?…。！？،؟।]') OR bars * 3 > n
         OR (regexp_matches(lower(line), '{_PHRASES}') AND length(line) < 160) AS fails FROM judged),
d AS (
  SELECT doc_id, coalesce(sum(chars) FILTER (chars > 0 AND fails), 0) AS lost,
         count(*) FILTER (chars > 0) - count(DISTINCT line) FILTER (chars > 0) AS dups FROM ruled GROUP BY doc_id),
b AS (
  SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '{_SPACE}', '', 'g')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, dups AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words, lost
  FROM w JOIN d USING (doc_id) LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND lost * 100 <= word_chars * 50 AS kept FROM f
"""


_ESC = "regexp_replace(coalesce({}, ''), '([<\\[|])', '\\1\\\\', 'g')"
_TURN = f"'<|' || {_ESC.format('role')} || '|>' || chr(10) || {_ESC.format('text')} || '<|end|>' || chr(10)"
OP3 = rf"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (SELECT conv_id, count(*) AS n_turns,
             string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn, role, text) AS turns,
             coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
             sum(length({_TURN}))::BIGINT AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

OP4 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size,
                  md5('mix|' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
e AS (SELECT *, ('0x' || substr(h, 1, 3))::INT AS block FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM e GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / w, source) AS k FROM s),
c AS (SELECT *, sum(3 * source_size) OVER (ORDER BY k) - 3 * source_size AS full_before, sum(w) OVER () - sum(w) OVER (ORDER BY k) + w AS open_weight,
             sum(source_size) OVER () AS total FROM r),
x AS (SELECT total - full_before AS rest, open_weight FROM c WHERE w * (total - full_before) <= 3 * source_size * open_weight ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, w, least(3.0 * source_size, (w * rest)::DOUBLE / open_weight)::DOUBLE AS target FROM s, x),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM t),
p AS (SELECT *, target - copies * source_size AS rest FROM q),
b AS (SELECT source, block, sum(size) AS block_size, md5('mix|' || coalesce(source, '') || '|' || block) AS bh FROM e GROUP BY source, block),
o AS (SELECT *, sum(block_size) OVER (PARTITION BY source ORDER BY bh, block) AS upto FROM b),
m AS (SELECT o.source, block, upto, upto - block_size AS before, rest, copies, target, source_size FROM o JOIN p ON o.source IS NOT DISTINCT FROM p.source),
u AS (SELECT e.source, e.h, e.block, sum(size) AS size, any_value(rest - before) AS budget
      FROM e JOIN m ON e.source IS NOT DISTINCT FROM m.source AND e.block = m.block WHERE before < rest AND upto > rest GROUP BY 1, 2, 3),
v AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h) - size / 2 AS mid FROM u),
z AS (SELECT source, max(h) AS cut FROM v WHERE mid < budget GROUP BY source)
SELECT doc_id, size, m.source_size, m.target,
       (size * (copies + CASE WHEN upto <= rest AND rest > 0 THEN 1 WHEN before < rest AND upto > rest AND h <= cut THEN 1 ELSE 0 END))::BIGINT AS taken
FROM e JOIN m ON e.source IS NOT DISTINCT FROM m.source AND e.block = m.block LEFT JOIN z ON e.source IS NOT DISTINCT FROM z.source
"""

OP6 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
n AS (SELECT *, list_transform([1, 11, 21, 31], lambda i: ('0x' || substr(h, i, 10))::BIGINT) AS parts FROM p),
d AS (SELECT page_id, html, h, array_to_string(list_transform(flatten(list_transform(parts, lambda v: list_transform(range(8), lambda i: (v >> (35 - 5 * i)) & 31))),
        lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x::INT + 1, 1)), '') AS payload_digest FROM n),
t AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM d)
SELECT page_id, strlen(html) AS payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to FROM t
"""

_UNIT = rf"{_SPACE}*{_WORD}|{_SPACE}+"
OP12 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_UNIT}') AS u,
                  sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS r FROM d),
f AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 50 THEN 'plain'
                  WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(p || m || s) AS restored_sha256 FROM g
"""

def _op13(rounds: int = 4) -> str:
    """All rounds written out: nearest entries, then means."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
n{r} AS (SELECT k, part, x, min(struct_pack(d := list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT, e := e)) AS near
         FROM p JOIN b{r} USING (part) GROUP BY k, part, x)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (SELECT part, e, list(v ORDER BY i) AS c FROM (
         SELECT part, near.e AS e, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS v FROM n{r}, (SELECT unnest(range(1, w + 1)) AS i FROM w) GROUP BY part, near.e, i) GROUP BY part, e),
b{r + 1} AS (SELECT b{r}.part, b{r}.e, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} ON b{r}.part = m{r}.part AND b{r}.e = m{r}.e)""")
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x,
                  row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS k FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT min(len(x)) // 4 AS w FROM v),
p AS (SELECT k, part, x[part * w + 1:(part + 1) * w] AS x FROM v, w, (SELECT unnest(range(4)) AS part)),
b0 AS (SELECT part, k AS e, x AS c FROM p WHERE k < 256),{",".join(steps)},
a AS (SELECT k, string_agg(printf('%02x', near.e), '' ORDER BY part) AS code, sum(near.d)::BIGINT AS error FROM n{rounds} GROUP BY k),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN a USING (k), h
"""


SQL = {
    "op3_chat_formatting": OP3, "op4_mixing": OP4, "op6_top_k": OP6, "op8_line_dedup": OP8, "op9_warc": OP9,
    "op10_quality_rules": OP10, "op12_fill_in_middle": OP12, "op13_vector_codes": _op13(),
}
