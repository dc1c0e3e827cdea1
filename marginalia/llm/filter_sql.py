"""SQL that checks the filters on documents and urls."""

from __future__ import annotations

from collections.abc import Sequence

from .quality_rules import WINDOW, RuleSpec
from .url_templates import TemplateSpec, UrlRule

RULES = RuleSpec()
TREE = TemplateSpec()

QUALITY_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, source, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM d),
windows AS (
  SELECT rid, i, words[i:i + {WINDOW - 1}] AS win
  FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS times FROM windows) WHERE times > 1),
covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, {WINDOW})) AS k) GROUP BY rid),
m AS (
  SELECT w.rid, doc_id, source, len(words)::BIGINT AS n_words, word_chars, n_symbols, len(lines) AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered ON w.rid = covered.rid),
b AS (
  SELECT *, n_words < {RULES.min_words} OR 100 * n_repeat_words > {RULES.max_repeat_words} * n_words AS base_failed FROM m),
f AS (
  SELECT *, base_failed OR 100 * n_symbols > {RULES.max_symbols} * n_words
            OR 100 * n_dup_lines > {RULES.max_dup_lines} * n_lines
            OR word_chars < {RULES.min_word_chars} * n_words OR word_chars > {RULES.max_word_chars} * n_words AS failed
  FROM b),
h AS (
  SELECT source, count(*) AS n, count(*) FILTER (failed) AS bad FROM f WHERE source IS NOT NULL GROUP BY source),
s AS (
  SELECT count(*) AS k, sum(n)::DOUBLE AS total, sum(bad)::DOUBLE AS bad, sum(n::DOUBLE * n) AS squares,
         sum(bad::DOUBLE * bad / n) AS rates, sum(bad) / sum(n) AS mean
  FROM h),
e AS (
  SELECT *, total - squares / total - (k - 1) AS room, mean * (1 - mean) AS noise FROM s),
v AS (
  SELECT mean, CASE WHEN total IS NULL OR bad = 0 OR bad = total THEN 1.0 ELSE
    1 / least(greatest(CASE WHEN room > 0
      THEN (rates - mean * mean * total - noise * (k - 1)) / (noise * room) ELSE 0 END, 1e-4), 0.999) - 1 END AS strength
  FROM e),
verdicts AS (
  SELECT source, (h.bad + mean * strength) / (n + strength)
           > least({RULES.max_host_rate}, mean + {RULES.host_deviations} * sqrt(mean * (1 - mean) / (strength + 1))) AS host_rejected
  FROM h, v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(host_rejected, false) AS host_rejected,
       NOT base_failed AND NOT (coalesce(host_rejected, false) AND failed) AS kept
FROM f LEFT JOIN verdicts ON f.source = verdicts.source"""


def url_sql(rules: Sequence[UrlRule]) -> str:
    """The same verdicts as ``judge_urls``, a step of SQL for each level of the tree."""
    ranked = sorted(rules, key=lambda rule: (-len(rule.name), rule.name))

    def first(value: str) -> str:
        fits = " ".join(
            f"WHEN (host = '{r.host}' OR suffix(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, value)}'"
            for r in ranked
        )
        return f"CASE {fits} END"

    levels = "".join(
        f"""
t{at + 1} AS (
  SELECT host, shape, n, labelled, blocked,
         CASE WHEN len(tpl) > {at} AND kids > {TREE.max_children}
              THEN list_concat(tpl[1:{at}], ['*'], tpl[{at + 2}:]) ELSE tpl END AS tpl
  FROM (SELECT *, count(DISTINCT tpl[{at + 1}]) OVER (PARTITION BY host, tpl[1:{at}]) AS kids FROM t{at})),"""
        for at in range(TREE.depth + 1)
    )
    return f"""
WITH RECURSIVE p AS (
  SELECT row_number() OVER () AS rid, page_id,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
g AS (
  SELECT *, {first("name")} AS rule, {first("verdict")} AS label,
         list_filter(string_split(regexp_replace(path, '[0-9]+', '*', 'g'), '/'), lambda s: s <> '') AS segments
  FROM p),
r AS (
  SELECT *, CASE WHEN len(segments) > {TREE.depth}
              THEN list_append(segments[1:{TREE.depth}], array_to_string(segments[{TREE.depth + 1}:], '/'))
              ELSE segments END AS shape
  FROM g),
t0 AS (
  SELECT host, shape, count(*) AS n, count(label) AS labelled, count(*) FILTER (label = 'block') AS blocked, shape AS tpl
  FROM r WHERE host <> '' GROUP BY host, shape),{levels}
prior AS (
  SELECT coalesce(sum(blocked) / sum(labelled), 0) AS p0 FROM t0),
nodes AS (
  SELECT host, shape, depth, tpl[1:greatest(depth - 1, 0)] AS parent,
         CASE WHEN depth = 0 THEN '' ELSE tpl[depth] END AS name, labelled, blocked
  FROM (SELECT *, unnest(range(0, len(tpl) + 1)) AS depth FROM t{TREE.depth + 1})),
counted AS (
  SELECT host, depth, parent, name, sum(labelled)::BIGINT AS n, sum(blocked)::BIGINT AS bad
  FROM nodes GROUP BY host, depth, parent, name HAVING sum(labelled) > 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY host, depth, parent ORDER BY bad / n, name) AS nr FROM counted),
pooling AS (
  SELECT host, depth, parent, name, nr, 1 AS pool, n, bad FROM placed WHERE nr = 1
  UNION ALL
  SELECT s.host, s.depth, s.parent, s.name, s.nr, pool + CASE WHEN joins THEN 0 ELSE 1 END,
         CASE WHEN joins THEN s.n + s.n_b ELSE s.n END, CASE WHEN joins THEN s.bad + s.bad_b ELSE s.bad END
  FROM (SELECT c.*, b.pool, b.n AS n_b, b.bad AS bad_b,
               c.bad / c.n - b.bad / b.n <= {TREE.z} * sqrt((b.bad + c.bad) / (b.n + c.n)
                 * (1 - (b.bad + c.bad) / (b.n + c.n)) * (1 / c.n + 1 / b.n)) AS joins
        FROM pooling b JOIN placed c
          ON b.host = c.host AND b.depth = c.depth AND b.parent = c.parent AND c.nr = b.nr + 1) s),
pools AS (
  SELECT host, depth, parent, name, last_value(n) OVER q AS n, last_value(bad) OVER q AS bad FROM pooling
  WINDOW q AS (PARTITION BY host, depth, parent, pool ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
ways AS (
  SELECT nodes.host, shape, list(struct_pack(p := 0.0::DOUBLE, n := coalesce(pools.n, 0)::DOUBLE, bad := coalesce(pools.bad, 0)::DOUBLE)
                                 ORDER BY nodes.depth) AS way
  FROM nodes LEFT JOIN pools ON nodes.host = pools.host AND nodes.depth = pools.depth AND nodes.parent = pools.parent
                            AND nodes.name = pools.name
  GROUP BY nodes.host, shape),
decided AS (
  SELECT host, shape, list_reduce(
           list_prepend(struct_pack(p := p0::DOUBLE, n := 0.0::DOUBLE, bad := 0.0::DOUBLE), way),
           lambda x, y: struct_pack(p := (y.bad + {TREE.strength}::DOUBLE * x.p) / (y.n + {TREE.strength}::DOUBLE), n := y.n, bad := y.bad)
         ).p > {TREE.max_blocked} AS rejected
  FROM ways, prior WHERE way[1].n > 0)
SELECT page_id, r.host, path, rule, '/' || array_to_string(t.tpl, '/') AS template,
       coalesce(label, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN t{TREE.depth + 1} t ON r.host = t.host AND r.shape = t.shape
       LEFT JOIN decided ON r.host = decided.host AND r.shape = decided.shape"""
