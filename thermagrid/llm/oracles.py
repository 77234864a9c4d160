"""SQL of the queries that SQL can express, for DuckDB on the same tables."""

from .quality import BANDS, levels

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIX = rf"""
WITH d AS (SELECT doc_id, text, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s, len({WORDS})::BIGINT AS size FROM documents),
sizes AS (SELECT s, sum(size)::BIGINT AS source_size FROM d GROUP BY s),
w AS (SELECT *, [1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE][((row_number() OVER (ORDER BY s) - 1) % 3 + 1)::INT] AS weight,
             (sum(source_size) OVER ())::DOUBLE AS total, 3.0::DOUBLE * source_size AS lim FROM sizes),
u AS (SELECT *, lim / weight AS ratio, (total - coalesce(sum(lim) OVER (ORDER BY lim / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY lim / weight, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
             row_number() OVER (ORDER BY lim / weight, s) AS step FROM w),
v AS (SELECT s, source_size, least(lim, coalesce((SELECT arg_min(level, step) FROM u WHERE level < ratio), 'inf'::DOUBLE) * weight) AS target FROM u),
p AS (SELECT d.doc_id, d.size, v.source_size, v.target, (sum(d.size) OVER (PARTITION BY d.s
        ORDER BY md5('mix:' || d.doc_id::VARCHAR), d.size, coalesce(md5(d.text), '') ROWS UNBOUNDED PRECEDING))::BIGINT - d.size AS start
      FROM d JOIN v USING (s))
SELECT doc_id, size, source_size, target, (
    greatest(0, least(size, floor(target + 0.5) - start)) + greatest(0, least(size, floor(target + 0.5) - start - source_size))
    + greatest(0, least(size, floor(target + 0.5) - start - 2 * source_size)))::BIGINT AS taken,
    CASE WHEN target > 0 THEN (start + size) / target END AS virtual_finish
FROM p
"""

_LEVELS = levels()
_SHARES = {"symbol_share": ("n_symbols", "word_chars"), "shout_share": ("n_shouts", "word_chars"),
           "repeat_share": ("n_repeat_words", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"),
           "run_share": ("n_runs", "n_words"), "capital_share": ("n_capitals", "word_chars")}
_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_shouts", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words", "n_runs"]


def _shares(alias: str) -> str:
    rows = ", ".join(f"('{rule}', CASE WHEN {alias}.{whole} > 0 THEN {alias}.{part} / {alias}.{whole}::DOUBLE ELSE 0.0 END)"
                     for rule, (part, whole) in _SHARES.items())
    return f"LATERAL (VALUES {rows}) AS sh(rule, share)"


_BAND = "CASE " + " ".join(f"WHEN n_words < {b} THEN {k}" for k, b in enumerate(BANDS)) + f" ELSE {len(BANDS)} END"

QUALITY = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: [i::VARCHAR, array_to_string(w[i:i + 7], ' ')])) AS x FROM t),
twice AS (SELECT doc_id, x[1]::INT AS pos FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, x[2]) > 1),
covered AS (SELECT doc_id, sum(least(8, coalesce(nxt - pos, 8)))::BIGINT AS n FROM (
    SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM twice) GROUP BY doc_id),
f AS (SELECT t.doc_id, len(w)::BIGINT AS n_words, length(text) - len(regexp_extract_all(text, '[\x20\x09-\x0D]')) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(text, '[!?]'))::BIGINT AS n_shouts,
        len(regexp_extract_all(text, '\p{{Lu}}'))::BIGINT AS n_capitals, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(covered.n, 0) AS n_repeat_words,
        len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_runs
      FROM t LEFT JOIN covered USING (doc_id)),
one AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT f.doc_id, any_value(quality) AS quality, {", ".join(f"max({c}) AS {c}" for c in _COLUMNS)} FROM f JOIN one USING (doc_id) GROUP BY f.doc_id),
good AS (SELECT doc_id, {_BAND} AS band, sh.rule, sh.share FROM held, {_shares('held')} WHERE quality = 1),
steps(step, rule, cut) AS (VALUES {", ".join(f"({k}, '{rule}', {cut!r}::DOUBLE)" for k, cuts in enumerate(_LEVELS) for rule, cut in cuts.items())}),
hits AS (SELECT doc_id, band, step, max((share > cut)::INT) AS hit FROM good JOIN steps USING (rule) GROUP BY ALL),
k AS (SELECT band, step, count(*) AS n, sum(hit)::BIGINT AS k FROM hits GROUP BY ALL),
tail AS (SELECT *, CASE WHEN k > n * 0.02 THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
        + i * ln(0.02) + (n - i) * ln(1 - 0.02))) FROM range(0, k + 1) r(i)) END AS p FROM k),
passed AS (SELECT *, min((p <= 0.05 / {len(BANDS) + 1})::INT) OVER (PARTITION BY band ORDER BY step) AS ok FROM tail),
cuts AS (SELECT band, rule, cut FROM (SELECT band, max(step) AS step FROM passed WHERE ok = 1 GROUP BY band) JOIN steps USING (step)),
broken AS (SELECT DISTINCT x.doc_id FROM (SELECT f.doc_id, {_BAND} AS band, sh.rule, sh.share FROM f, {_shares('f')}) x
           JOIN cuts USING (band, rule) WHERE x.share > cuts.cut),
base AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM broken) AS kept
FROM base
"""

SIMILAR = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (shingle)
            WHERE x.doc_id <> y.doc_id GROUP BY 1, 2) p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
          WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(reach.b) AS component_id
FROM t LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = t.doc_id GROUP BY t.doc_id, n.n
"""

AUDIT = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
f AS (SELECT *, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) AS c,
             regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
      FROM f LEFT JOIN l USING (doc_id)),
g AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM m GROUP BY ALL),
x(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT p.letter || q.letter || r.letter || s.letter || u.letter AS filter_order, [p.bit, q.bit, r.bit, s.bit, u.bit] AS bits
      FROM x p, x q, x r, x s, x u WHERE p.bit | q.bit | r.bit | s.bit | u.bit = 31),
st AS (SELECT filter_order, step, bits[step] AS own, list_sum(bits[1:step - 1])::BIGINT AS prior FROM o, range(1, 6) r(step)),
res AS (SELECT part, filter_order, step, own,
          coalesce(sum(n) FILTER (mask & (coalesce(prior, 0) | own) = 0), 0)::BIGINT AS kept,
          coalesce(sum(n) FILTER (mask & coalesce(prior, 0) = 0 AND mask & own > 0), 0)::BIGINT AS removed,
          coalesce(sum(n) FILTER (mask & coalesce(prior, 0) > 0 AND mask & own > 0), 0)::BIGINT AS redundant,
          coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
          coalesce(sum(n_good) FILTER (mask & coalesce(prior, 0) = 0 AND mask & own > 0), 0)::BIGINT AS good_lost,
          coalesce(sum(n_toxic) FILTER (mask & coalesce(prior, 0) = 0 AND mask & own > 0), 0)::BIGINT AS toxic_lost
        FROM g, st GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM res
"""

ORACLES = {"op11_filter_audit": AUDIT, "op6_similar_documents": SIMILAR, "op8_quality_rules": QUALITY, "op10_mix_sources": MIX}
