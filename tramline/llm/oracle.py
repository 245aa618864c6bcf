"""SQL of the text operators that SQL can express, for DuckDB."""

from __future__ import annotations

from tramline.llm.quality_rules import CLASSES, COMMON_SHARE

MIX = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
    (CAST('0x' || substr(md5('11:' || doc_id), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight
  FROM d GROUP BY source),
l AS (SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / weight AS level FROM s),
o AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
    sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_, sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM l),
t AS (SELECT *, (total - full_) / open_ AS t FROM o),
p AS (
  SELECT source, source_size, weight, coalesce(least(most, weight * (SELECT arg_min(t, level) FROM t WHERE t <= level)), most) AS target,
    weight * (1 + weight / 3.0::DOUBLE) / 2 AS last_weight FROM t),
r AS (
  SELECT d.*, p.source_size, p.target, p.weight, p.last_weight, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS end_
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
q AS (SELECT *, floor(target / greatest(source_size, 1)) AS passes, end_ - size / 2 AS middle FROM r),
n AS (SELECT *, CASE WHEN size > 0 THEN CAST(passes AS BIGINT) + CAST(middle <= target - passes * source_size AS BIGINT) ELSE 0 END AS times FROM q),
x AS (SELECT *, middle / target AS share1, (source_size + middle) / target AS share2 FROM n)
SELECT doc_id, size, source_size, target, source, CAST(size * times AS BIGINT) AS taken,
  round(CASE WHEN times < 1 THEN NULL WHEN abs(last_weight - weight) < 1e-12 THEN share1
    ELSE 2 * share1 * (weight + last_weight) / (2 * (weight + sqrt(weight * weight + (last_weight - weight) * share1 * (weight + last_weight)))) END, 9) AS position,
  round(CASE WHEN times < 2 THEN NULL WHEN abs(last_weight - weight) < 1e-12 THEN share2
    ELSE 2 * share2 * (weight + last_weight) / (2 * (weight + sqrt(weight * weight + (last_weight - weight) * share2 * (weight + last_weight)))) END, 9) AS second_position
FROM x"""


def rules() -> str:
    """The rules of ``quality_rules.rules`` with its defaults."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    steps = ", ".join(f"regexp_replace(x{i}, {text(c + '+')}, '', 'g') AS x{i + 1}" for i, c in enumerate(CLASSES))
    n = len(CLASSES)
    counts = ", ".join(f"length(x{i}) - length(x{i + 1})" for i in range(n))
    term = lambda v, m: f"CASE WHEN {v} > 0 THEN {v} * log2({v} / {m}) ELSE 0 END"
    distance = f"sqrt(greatest(list_sum(list_transform(list_zip({{p}}, {{q}}), lambda z: ({term('z[1]', '((z[1] + z[2]) / 2)')} + {term('z[2]', '((z[1] + z[2]) / 2)')}) / 2)), 0))"
    shares = "list_transform({c}, lambda v: CASE WHEN list_sum({c}) > 0 THEN v / list_sum({c}) ELSE 0 END)"
    return rf"""
WITH a AS (SELECT doc_id, coalesce(lang, 'und') AS lang, coalesce(text, '') AS x0 FROM documents),
b AS (SELECT *, {steps} FROM a),
c AS (
  SELECT *, list_filter(regexp_split_to_array(x0, '[\x20\x09-\x0D]+'), lambda v: v <> '') AS ws,
    list_filter(regexp_split_to_array(lower(x0), '[\x20\x09-\x0D]+'), lambda v: v <> '') AS plain,
    list_transform([{counts}, length(x{n})], lambda v: CAST(v AS DOUBLE)) AS classes,
    list_filter(string_split(x0, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) AS lines
  FROM b),
l AS (SELECT lang, plain FROM c WHERE len(plain) >= 60),
ln AS (SELECT lang, count(*) AS n FROM l GROUP BY 1 HAVING count(*) >= 5),
lw AS (SELECT lang, word, sum(part) AS part FROM (SELECT lang, unnest(plain) AS word, 1.0::DOUBLE / len(plain) AS part FROM l) GROUP BY 1, 2),
common AS (SELECT lw.lang, list(word ORDER BY word) AS common FROM lw JOIN ln ON lw.lang = ln.lang WHERE part >= {COMMON_SHARE}::DOUBLE * n AND regexp_matches(word, '\p{{L}}') GROUP BY 1),
d AS (
  SELECT doc_id, c.lang, x0, ws, classes, lines, list_transform(common, lambda w: CAST(len(list_filter(plain, lambda v: v = w)) AS DOUBLE)) AS hits, CAST(len(plain) AS DOUBLE) AS n_plain
  FROM c LEFT JOIN common ON c.lang = common.lang),
e AS (SELECT *, list_append(hits, n_plain - list_sum(hits)) AS counted FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 4], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM e WHERE len(ws) >= 5)),
h AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
k AS (SELECT doc_id, CAST(sum(least(5, coalesce(after - i, 5))) AS BIGINT) AS n_repeat_words FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM h) GROUP BY 1),
f AS (
  SELECT e.doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(x0, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(x0) - length(regexp_replace(x0, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(k.n_repeat_words, 0) AS n_repeat_words, {shares.format(c='classes')} AS p_class, CASE WHEN hits IS NOT NULL THEN {shares.format(c='counted')} END AS p_word
  FROM e LEFT JOIN k ON k.doc_id = e.doc_id),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
uc AS (SELECT lang, i, avg(p_class[i]) AS x, count(*) AS n FROM m, range(1, {n + 2}) t(i) WHERE NOT base_failed GROUP BY 1, 2),
uw AS (SELECT lang, i, avg(x) AS x FROM (SELECT lang, unnest(p_word) AS x, generate_subscripts(p_word, 1) AS i FROM m WHERE NOT base_failed AND p_word IS NOT NULL) GROUP BY 1, 2),
vw AS (SELECT lang, list(x ORDER BY i) AS q_word FROM uw GROUP BY 1),
v AS (SELECT uc.lang, list(x ORDER BY i) AS q_class, any_value(q_word) AS q_word FROM uc LEFT JOIN vw ON uc.lang = vw.lang WHERE n >= 5 GROUP BY 1),
o AS (SELECT *, list_transform(range(1, len(q_word) + 1), lambda i: CASE WHEN i = len(q_word) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p_none FROM v),
r AS (SELECT *, {distance.format(p='p_none', q='q_word')} AS none FROM o),
z AS (
  SELECT m.*, {distance.format(p='p_class', q='q_class')} AS class_distance, {distance.format(p='p_word', q='q_word')} / nullif(none, 0) AS word_distance
  FROM m LEFT JOIN r ON r.lang = m.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (coalesce(class_distance, 0) <= 0.25 OR word_chars < 200) AND (coalesce(word_distance, 0) <= 0.85 OR n_words < 60) AS kept,
  round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance
FROM z"""


ORACLE_SQL = {"op9_divergence": rules(), "op10_curriculum": MIX}
