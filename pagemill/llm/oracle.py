"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from pagemill.llm import mixing, url_filter


def _rules_sql() -> tuple[str, str]:
    fits = []
    for verdict, host, path in sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2])):
        fits.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')", host + path, verdict))
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits) + " WHEN listed THEN 'block' ELSE 'allow' END"
    return rule, verdict


_RULE, _VERDICT = _rules_sql()
_LISTED = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in url_filter.LISTED_HOSTS)

OP2 = f"""
WITH urls AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
marked AS (SELECT *, ({_LISTED}) AS listed FROM urls)
SELECT page_id, host, path, {_RULE} AS rule, {_VERDICT} AS verdict, listed FROM marked
"""

_WEIGHT = "CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END"
_EARLY = "CASE place % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END"
_LATE = "CASE place % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END"


def _due(k: int) -> str:
    share = f"((began + source_size * {k})::DOUBLE / greatest(goal, 1))"
    asked = f"({share} * (early + late) / 2)"
    t = f"least(1.0::DOUBLE, 2 * {asked} / (early + sqrt(greatest(0.0::DOUBLE, early * early + 2 * (late - early) * {asked}))))"
    return f"CASE WHEN began + source_size * {k} < goal AND size > 0 THEN round({t}, 9) END"


OP5 = f"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(sha1(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS draw
  FROM documents),
total AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM sizes GROUP BY source),
filled AS (
  SELECT *, {_WEIGHT} AS weight, source_size * {mixing.MAX_REPEATS} AS cap, source_size * {mixing.MAX_REPEATS} / ({_WEIGHT}) AS full_at FROM total),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM filled) * {mixing.BUDGET}::DOUBLE - coalesce(sum(cap) OVER w, 0))
    / ((SELECT sum(weight) FROM filled) - coalesce(sum(weight) OVER w, 0)) AS level
  FROM filled WINDOW w AS (ORDER BY full_at, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT arg_min(level, (full_at, place)) AS water FROM levels WHERE level <= full_at),
plan AS (
  SELECT source, source_size, {_EARLY} AS early, {_LATE} AS late,
    round(least(cap::DOUBLE, coalesce((SELECT water FROM water), 'infinity'::DOUBLE) * weight), 6) AS target
  FROM levels),
counted AS (
  SELECT doc_id, size, source_size, target, early, late, round(target)::BIGINT AS goal,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS began
  FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, goal - began)) + greatest(0, least(size, goal - source_size - began)))::BIGINT AS taken,
  {_due(0)} AS position, {_due(1)} AS repeat_position
FROM counted
"""

OP12 = r"""
WITH base AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS nr FROM documents),
found AS (SELECT lang, source, nr, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM base),
counted AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT nr) AS docs FROM found GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::BIGINT AS n FROM counted GROUP BY ALL HAVING sum(docs) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM kept GROUP BY lang),
grid AS (SELECT g.lang, g.source, k.term, k.n AS all_n, coalesce(c.n, 0) AS n, v, total, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS size
  FROM (SELECT DISTINCT lang, source FROM base) g JOIN kept k USING (lang) JOIN langs USING (lang)
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (SELECT lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 2) // (size + 2 * v))::BIGINT AS p, (1 + 1000000000::HUGEINT * (all_n + 2) // (total + 2 * v))::BIGINT AS q FROM grid),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM base),
every_pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
lines AS (SELECT lang, source, 'pair' AS part, item, value FROM every_pair
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM lines)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

OP13 = r"""
WITH RECURSIVE base AS (SELECT doc_id, row_number() OVER () AS nr, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
digits AS (SELECT *, doc_id::VARCHAR AS d FROM base),
-- The checksum: a bit at a time, over the bytes of the decimal number.
summed AS (SELECT *, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, range(8 * length(d))),
    lambda acc, k: (CASE WHEN xor(acc, CASE WHEN k % 8 = 0 THEN ascii(substr(d, (k // 8 + 1)::INTEGER, 1)) ELSE 0 END::BIGINT) % 2 = 1
      THEN xor(xor(acc, CASE WHEN k % 8 = 0 THEN ascii(substr(d, (k // 8 + 1)::INTEGER, 1)) ELSE 0 END::BIGINT) // 2, 3988292384::BIGINT)
      ELSE xor(acc, CASE WHEN k % 8 = 0 THEN ascii(substr(d, (k // 8 + 1)::INTEGER, 1)) ELSE 0 END::BIGINT) // 2 END))) AS h FROM digits),
planned AS (SELECT *, length(words) AS n, h // 10 AS g FROM summed),
placed AS (SELECT *, CASE WHEN n > 0 AND h % 10 = 0 THEN g % n END AS a FROM planned),
docs AS (SELECT doc_id, nr, n, CASE WHEN a IS NULL THEN words
    ELSE list_transform(range(n), lambda i: words[(CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1)::BIGINT]) END AS words FROM placed),
word AS (SELECT nr, n, unnest(words) AS w, unnest(range(n)) AS i FROM docs),
equal AS (SELECT x.nr, y.i - x.i AS q, x.i FROM word x JOIN word y ON x.nr = y.nr AND x.w = y.w AND y.i > x.i AND y.i - x.i <= x.n // 4),
islands AS (SELECT nr, q, i, i - row_number() OVER (PARTITION BY nr, q ORDER BY i) AS island FROM equal),
stretches AS (SELECT nr, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY nr, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT nr, start, length, min(q) AS period FROM stretches GROUP BY nr, start, length),
per AS (SELECT nr, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told,
    arg_max(struct_pack(s := start, l := length, p := period), (length, -start, -period)) AS best FROM runs GROUP BY nr),
gone AS (SELECT DISTINCT nr, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT word.nr, string_agg(w, ' ' ORDER BY word.i) AS text FROM word ANTI JOIN gone ON word.nr = gone.nr AND word.i = gone.i GROUP BY word.nr)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, 1000 * best.l // best.p AS exponent_milli,
  sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM docs LEFT JOIN per ON docs.nr = per.nr LEFT JOIN kept ON docs.nr = kept.nr
"""

ORACLE_SQL = {"op2_url_filter": OP2, "op5_mixing": OP5, "op12_divergence": OP12, "op13_periodic_runs": OP13}
