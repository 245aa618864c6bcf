"""SQL of the conversation trie, of the dataset manifest and of near duplicates, for DuckDB."""

from __future__ import annotations

# CRC-32 of a number in decimal: eight steps a byte, without a table
CRC = """CAST(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT))), lambda crc, ch:
  list_reduce(list_prepend(xor(crc, ch), [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, _: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) AS BIGINT)"""

TRIE = f"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, c - c % 5 AS b, {CRC.format(x='c')} % 9 AS h, count(*) AS n FROM t GROUP BY c),
r AS (
  SELECT k.c, t.pos AS d, role, text FROM k JOIN t ON t.c = k.b WHERE t.pos <= k.h
  UNION ALL
  SELECT k.c, t.pos - k.h + least(k.h, coalesce(o.n, 0)) AS d, role, text FROM k JOIN t ON t.c = k.c LEFT JOIN k o ON o.c = k.b WHERE t.pos > k.h),
p AS (
  SELECT c, d, octet_length(encode(text)) AS bytes, list(sha256(octet_length(encode(role)) || ':' || role || text)) OVER (PARTITION BY c ORDER BY d) AS seq FROM r
  UNION ALL SELECT c, 0, 0, [] FROM k),
q AS (SELECT c, d, bytes, min(c) OVER (PARTITION BY d, seq) AS node, d = max(d) OVER (PARTITION BY c) AS ends FROM p),
m AS (SELECT q.*, u.node AS parent FROM q LEFT JOIN q u ON u.c = q.c AND u.d = q.d - 1),
v AS (
  SELECT node, d, any_value(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
    coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS ids
  FROM m GROUP BY node, d),
w AS (SELECT v.*, (SELECT count(*) FROM v x WHERE x.parent = v.node AND x.d = v.d + 1) AS n_children FROM v),
s AS (
  SELECT a.node, a.d, count(*) FILTER (w.n_children = 0) AS n_leaves, sum(w.saved) AS saved
  FROM w JOIN q a ON a.c = w.node AND a.d <= w.d GROUP BY a.node, a.d)
SELECT w.node AS conv_id, CAST(w.d AS BIGINT) AS depth, w.parent AS parent_conv_id, CAST(w.n_convs AS BIGINT) AS n_convs, CAST(w.n_children AS BIGINT) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(w.ids) AS ends_sha256
FROM w JOIN s ON s.node = w.node AND s.d = w.d"""


def manifest(levels: int = 12) -> str:
    """``merkle.manifest`` with every leaf checked; trees of up to 8 to the ``levels`` leaves."""
    field = lambda c: f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    low = "CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"

    def tree(name: str, leaves: str) -> tuple[str, str]:
        """Levels of the trees of ``leaves(tree, place, hash)``: a run of one level is a node of the next."""
        steps = [f"{name}0 AS (SELECT tree, place, hash, count(*) OVER (PARTITION BY tree) AS n FROM {leaves})"]
        for k in range(levels):
            steps.append(
                f"{name}{k + 1} AS (SELECT tree, place // 8 AS place, sha256(string_agg(hash, '' ORDER BY place)) AS hash, max(n) + 7 >> 3 AS n FROM {name}{k} WHERE n > 1 GROUP BY tree, place // 8)"
            )
        return ", ".join(steps), " UNION ALL ".join(f"SELECT tree, hash FROM {name}{k} WHERE n = 1" for k in range(levels + 1))

    def climb(name: str, of: str, begin: str) -> str:
        """From ``begin(row, tree, place, proof, fold)`` up the levels: siblings are joined to the proof and folded in."""
        steps = []
        for k in range(levels):
            at = begin if k == 0 else f"{name}{k}"
            before, after = (f"(SELECT coalesce(string_agg(s.hash, '' ORDER BY s.place), '') FROM {of}{k} s WHERE s.tree = b.tree AND s.place // 8 = b.place // 8 AND s.place {op} b.place)" for op in "<>")
            has = f"(SELECT count(*) FROM {of}{k} s WHERE s.tree = b.tree AND s.n > 1 AND s.place = b.place)"
            steps.append(
                f"{name}{k}_ AS (SELECT b.*, {before} AS l, {after} AS r, {has} AS inner_ FROM {at} b), "
                f"{name}{k + 1} AS (SELECT id, tree, place // 8 AS place, CASE WHEN inner_ > 0 THEN proof || l || r ELSE proof END AS proof, CASE WHEN inner_ > 0 THEN sha256(l || fold || r) ELSE fold END AS fold FROM {name}{k}_)"
            )
        return ", ".join(steps)

    inner, subroots = tree("t", "placed")
    upper, root = tree("u", "(SELECT 0 AS tree, tree AS place, hash FROM subroots)")
    return f"""
WITH h AS (SELECT *, coalesce({CRC.format(x='doc_id')} % 3 = 0, false) AS hit FROM documents),
f AS (SELECT doc_id, lang, {leaf('text')} AS hash, {leaf('(' + low + ')')} AS seen FROM h),
placed AS (SELECT *, row_number() OVER () AS id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, hash) - 1 AS place FROM f),
{inner}, subroots AS ({subroots}), {upper}, root AS ({root}),
b AS (SELECT id, tree, place, '' AS proof, seen AS fold FROM placed),
{climb('c', 't', 'b')},
e AS (SELECT id, 0 AS tree, tree AS place, proof, fold FROM c{levels}),
{climb('d', 'u', 'e')}
SELECT doc_id, placed.hash AS leaf, subroots.hash AS subroot, root.hash AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root.hash AS verified
FROM placed JOIN d{levels} ON d{levels}.id = placed.id JOIN subroots ON subroots.tree = placed.tree, root"""


#: ``minhash_dedup.mark`` with its defaults: every pair that shares a shingle, and what links reach.
NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id, least(w.doc_id, coalesce(low, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id"""


SQL = {"op11_prefix_trie": TRIE, "op12_merkle": manifest(4), "op13_minhash_dedup": NEAR}
