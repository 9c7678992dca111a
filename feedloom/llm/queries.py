"""One query for each operator over its whole table, and SQL twins where SQL can express them."""

from __future__ import annotations

from .ann import op8_ann
from .bpe import op5_bpe
from .chat import op6_chat
from .decontam import op7_decontam
from .lm import op3_lm
from .media import op11_media
from .neardup import op2_neardup
from .quality import op10_quality
from .resample import op13_resample
from .sharding import op1_sharding
from .substring import op4_substring
from .toxicity import op9_toxicity
from .trie import op12_trie

QUERIES = {f.__name__: f for f in (op1_sharding, op2_neardup, op3_lm, op4_substring, op5_bpe, op6_chat, op7_decontam, op8_ann, op9_toxicity, op10_quality, op11_media, op12_trie, op13_resample)}
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED = r"'[^ \x09-\x0D]+'"

OP2 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOW}'), {SPACED}) AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(list_slice(ws, i, i + 3), ' '))
                               WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 80 * (x.n + y.n - i)),
ties AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, ties.v FROM reach r JOIN ties ON ties.u = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
       d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

OP4 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {SPACED}) AS ws FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS pos, ws FROM w WHERE len(ws) >= 50),
x AS (SELECT doc_id, pos, md5(array_to_string(list_slice(ws, pos, pos + 49), ' ')) AS h FROM t),
m AS (SELECT h, min(doc_id) AS least FROM x GROUP BY 1),
hit AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS pos FROM x JOIN m USING (h) WHERE doc_id > least),
k AS (SELECT w.doc_id, len(ws) AS n_words, u.pos, u.word FROM w, LATERAL (SELECT unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos) u),
kept AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM k ANTI JOIN hit USING (doc_id, pos) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""

OP7 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
i AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, pos, pos + n - 1), ' ') AS w FROM (SELECT item_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS pos FROM i)),
dw AS (SELECT doc_id, pos, n, array_to_string(list_slice(ws, pos, pos + n - 1), ' ') AS w
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM i) WHERE len(ws) >= n)),
h AS (SELECT doc_id, pos, n, item_id FROM dw JOIN iw USING (w, n)),
p AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS pos FROM h),
c AS (SELECT doc_id, count(*) AS n_hit FROM p GROUP BY 1),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)"""

OP6 = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM t),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(line, '' ORDER BY n) AS chat,
             list({'r': role, 't': text} ORDER BY n) AS turns FROM r GROUP BY 1),
u AS (SELECT turns, min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, any_value(chat) AS chat, count(*) AS copies FROM c GROUP BY 1),
p AS (SELECT conv_id, list_slice(turns, 1, k) AS part FROM (SELECT conv_id, turns, unnest(range(1, n_turns)) AS k FROM u)),
m AS (SELECT * FROM u ANTI JOIN p ON u.turns = p.part),
s AS (SELECT p.conv_id, sum(u.copies) AS inside FROM p JOIN u ON u.turns = p.part GROUP BY 1)
SELECT m.conv_id, m.n_turns, CAST(m.copies + coalesce(s.inside, 0) AS BIGINT) AS n_snapshots, m.chat FROM m LEFT JOIN s USING (conv_id)"""

def crc32_of(numbers: str) -> str:
    """SQL for the CRC-32 of a list of byte values."""
    bits = "list_reduce(list_prepend(xor(r, c), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {numbers}), lambda r, c: {bits}), 4294967295)"


BYTES = "list_transform(range(1, len({0}), 2), lambda i: CAST(16 * (instr('0123456789ABCDEF', {0}[i]) - 1) + instr('0123456789ABCDEF', {0}[i + 1]) - 1 AS BIGINT))"

OP12 = f"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS home, count(*) AS own, {crc32_of("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))")} % 9 AS takes FROM t GROUP BY 1),
n AS (SELECT c.*, least(c.takes, coalesce(b.own, 0)) AS given FROM c LEFT JOIN c b ON b.conv_id = c.home),
r AS (SELECT n.conv_id, t.pos, role, text FROM n JOIN t ON t.conv_id = n.home AND t.pos <= takes
      UNION ALL SELECT n.conv_id, t.pos - takes + given, role, text FROM n JOIN t ON t.conv_id = n.conv_id AND t.pos > takes),
p AS (SELECT n.conv_id, coalesce(list(struct_pack(r := role, t := text) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS path FROM n LEFT JOIN r USING (conv_id) GROUP BY 1),
m AS (SELECT conv_id, len(path) AS n, d, list_slice(path, 1, d) AS node FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM p)),
g AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends FROM m GROUP BY 1, 2),
k AS (SELECT list_slice(node, 1, d - 1) AS node, count(*) AS kids FROM g WHERE d > 0 GROUP BY 1),
f AS (SELECT g.*, coalesce(kids, 0) AS kids, CASE WHEN d > 0 THEN (n_convs - 1) * strlen(node[d].t) ELSE 0 END AS saved FROM g LEFT JOIN k USING (node)),
u AS (SELECT list_slice(node, 1, e) AS node, sum(saved) AS saved, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves FROM (SELECT node, saved, kids, unnest(range(0, d + 1)) AS e FROM f) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.kids AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN u USING (node) LEFT JOIN g q ON q.d = f.d - 1 AND q.node = list_slice(f.node, 1, f.d - 1)"""

OP13 = f"""
WITH a AS (SELECT doc_id, text, true AS ours FROM documents UNION ALL SELECT NULL, text, false FROM benchmark),
w AS (SELECT doc_id, ours, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM a),
f AS (SELECT row, ours, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM w),
h AS (SELECT f, {crc32_of(BYTES.format("x"))} % 10000 AS b FROM (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f))),
n AS (SELECT row, ours, b, count(*) AS n FROM f JOIN h USING (f) GROUP BY 1, 2, 3),
s AS (SELECT b, coalesce(sum(n) FILTER (ours), 0) AS s, coalesce(sum(n) FILTER (NOT ours), 0) AS t FROM n GROUP BY 1),
z AS (SELECT CAST(sum(s) AS DOUBLE) + 10000 AS s, CAST(sum(t) AS DOUBLE) + 10000 AS t FROM s),
g AS (SELECT b, CAST(floor(1000 * ln((CAST(s.t + 1 AS DOUBLE) * z.s) / (CAST(s.s + 1 AS DOUBLE) * z.t))) AS BIGINT) AS g FROM s, z),
e AS (SELECT row, sum(n) AS n, CAST(floor(sum(n * g) / sum(n)) AS BIGINT) AS weight FROM n JOIN g USING (b) WHERE ours GROUP BY 1),
d AS (SELECT doc_id, row, len(ws) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
             CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN e USING (row) WHERE ours),
o AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM d),
r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank, count(*) OVER () AS n FROM o WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * r.n // 100 THEN rank END AS rank FROM o LEFT JOIN r USING (row)"""

ORACLES: dict[str, str] = {"op6_chat": OP6, "op7_decontam": OP7, "op2_neardup": OP2, "op4_substring": OP4, "op12_trie": OP12, "op13_resample": OP13}
