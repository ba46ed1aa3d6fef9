"""SQL that checks the queries of this subpackage, where SQL can express them."""

from episodika.llm import chats, secrets
from episodika.llm.common import LOWER, UPPER
from episodika.llm.variants import LETTERS

_LOWER = f"translate({{}}, '{UPPER}', '{LOWER}')"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.line, k.pos, r.keeper IS NOT NULL AND k.doc_id <> r.keeper AS dropped FROM k LEFT JOIN r ON r.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256 FROM m GROUP BY doc_id"""

EXACT_DEDUP = f"""WITH n AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON g.t = n.t"""

_SHOWN = "replace(replace({}, '" + chats.START + "', '<im_start>'), '" + chats.END + "', '<im_end>')"

CHATS = f"""WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT conv_id, turn, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS total,
  sha256(string_agg(turn || chr(1) || role || chr(2) || text, chr(3)) OVER (w ROWS UNBOUNDED PRECEDING)) AS prefix FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
e AS (SELECT total AS n, prefix, min(conv_id) AS conv_id, count(*) AS copies FROM s WHERE n = total GROUP BY 1, 2),
m AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.n < s.total AND s.n = e.n AND s.prefix = e.prefix))
SELECT t.conv_id, t.turn // {chats.PART} AS part, any_value(m.n) AS turns, any_value(copies) AS copies, count(*) AS n_turns,
  string_agg('{chats.START}' || {_SHOWN.format("role")} || chr(10) || {_SHOWN.format("text")} || '{chats.END}' || chr(10), '' ORDER BY turn) AS rendered
FROM t JOIN m ON m.conv_id = t.conv_id GROUP BY 1, 2"""


def _found(pattern: str, group: int, rank: int) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return (
        f"SELECT doc_id, {rank} AS rank, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {group}) AS v, regexp_split_to_array(t, {p}) AS g "
        f"FROM d WHERE regexp_matches(t, {p})"
    )


_PAIRS = " OR ".join(f"(w.r = {weak} AND o.r IN ({', '.join(map(str, needs))}))" for weak, needs in secrets.PARTNERS.items())
_NAMED = f"([{', '.join(repr(k) for k in secrets.KINDS)}])[r + 1] || ':' || s || ':' || e"

SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_found(*x) for x in [(secrets.ASSIGN, 1, 0), (secrets.ACCESS, 0, 1), (secrets.HEX, 0, 2), (secrets.LOGIN, 1, 4), (secrets.ENDPOINT, 0, 5)])}),
u AS (SELECT *, unnest(generate_series(1, len(m))) AS i FROM f),
p AS (SELECT doc_id, rank, length(m[i]) AS len, length(v[i]) AS size, sum(length(g[i]) + length(m[i])) OVER (PARTITION BY doc_id, rank ORDER BY i) AS e FROM u),
c AS (SELECT doc_id, CAST(e - len AS BIGINT) AS s, CAST(e AS BIGINT) AS e, CASE WHEN rank = 0 AND size < {secrets.ASSIGN_CHARS} THEN CASE WHEN size >= {secrets.WEAK_CHARS} THEN 3 END
  WHEN rank = 1 AND size < {secrets.ACCESS_CHARS} THEN NULL ELSE rank END AS r FROM p),
a AS (SELECT * FROM c WHERE r < 3 UNION ALL SELECT * FROM c w WHERE r >= 3 AND EXISTS (SELECT 1 FROM c o WHERE o.doc_id = w.doc_id
  AND o.s <= w.e + {secrets.SCOPE} AND o.e >= w.s - {secrets.SCOPE} AND ({_PAIRS}))),
x AS (SELECT doc_id, count(*) FILTER (WHERE r = 0) AS n_assign, count(*) FILTER (WHERE r = 1) AS n_access, count(*) FILTER (WHERE r = 2) AS n_hex,
  string_agg({_NAMED}, ',' ORDER BY s, r) FILTER (WHERE r < 3) AS base, string_agg({_NAMED}, ',' ORDER BY s, r) AS spans FROM a GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN x ON x.doc_id = d.doc_id"""

# CRC-32: a table of 256 remainders, and a string's bytes drawn through it
_CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
  lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""
_HEX = "instr('0123456789ABCDEF', substr({h}, {at}, 1)) - 1"


def _crc(text: str) -> str:
    h = f"hex(encode({text}))"
    byte = f"({_HEX.format(h=h, at='2 * i + 1')}) * 16 + {_HEX.format(h=h, at='2 * i + 2')}"
    return (
        f"xor(list_reduce(list_prepend(4294967295, list_transform(range(length({h}) // 2), lambda i: {byte})), "
        "lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)"
    )


_KEY = "md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))"

TRIE = f"""WITH {_CRC_TABLE},
t AS (SELECT conv_id, {_KEY} AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_KEY}) AS r FROM conversations),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_crc("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
b AS (SELECT c.conv_id, 0 AS part, r, key, words FROM c JOIN t ON t.conv_id = c.base AND t.r <= c.h
  UNION ALL SELECT c.conv_id, 1, r, key, words FROM c JOIN t ON t.conv_id = c.conv_id AND t.r > c.h),
s AS (SELECT conv_id, row_number() OVER w AS depth, words, sha256(string_agg(key, ',') OVER (w ROWS UNBOUNDED PRECEDING)) AS node,
  count(*) OVER (PARTITION BY conv_id) AS total FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY part, r)),
m AS (SELECT conv_id, depth, words, node, total FROM s
  UNION ALL SELECT c.conv_id, 0, 0, '', coalesce(max(s.total), 0) FROM c LEFT JOIN s ON s.conv_id = c.conv_id GROUP BY c.conv_id),
p AS (SELECT m.*, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM m),
n AS (SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
  coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = total), '') AS ends FROM p GROUP BY depth, node),
k AS (SELECT parent, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.parent = n.node),
u AS (SELECT m.node, sum((f.n_convs - 1) * f.words) AS saved_tokens, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves
  FROM f JOIN m ON m.conv_id = f.conv_id AND m.depth <= f.depth GROUP BY m.node)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, u.n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN u ON u.node = f.node LEFT JOIN f q ON q.node = f.parent"""

_RUN = "[" + LETTERS + "]{7,}"

VARIANTS = f"""WITH RECURSIVE {_CRC_TABLE},
o AS (SELECT doc_id, {_LOWER.format("unnest(regexp_extract_all(coalesce(text, ''), '" + _RUN + "'))")} AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n FROM o GROUP BY doc_id, run),
h AS (SELECT run, n, {_crc("doc_id || ':' || run")} AS h FROM d, crc),
e AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
x AS (SELECT word, n, unnest(range(length(word) + 1)) AS i FROM w),
skipped AS (SELECT word, n, substr(word, i + 2) || ' ' || substr(word, 1, i) AS prefix FROM x WHERE i < length(word)),
entire AS (SELECT word, n, substr(word, i + 1) || ' ' || substr(word, 1, i) AS prefix FROM x),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM skipped a JOIN skipped b ON a.prefix = b.prefix AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM skipped a JOIN entire b ON a.prefix = b.prefix
  UNION SELECT b.word, a.word, a.n FROM skipped a JOIN entire b ON a.prefix = b.prefix),
g AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n
  FROM w LEFT JOIN g ON g.word = w.word),
r AS (SELECT word, word AS root, 0 AS steps FROM f UNION ALL SELECT r.word, f.form, r.steps + 1 FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL),
l AS (SELECT word, arg_max(root, steps) AS root FROM r GROUP BY word)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM f JOIN l ON l.word = f.word"""

ORACLES: dict[str, str] = {
    "op1_line_dedup": LINE_DEDUP, "op3_secret_scans": SECRETS, "op6_chat_formatting": CHATS, "op9_exact_dedup": EXACT_DEDUP, "op11_prefix_trie": TRIE,
    "op13_spelling_variants": VARIANTS,
}
