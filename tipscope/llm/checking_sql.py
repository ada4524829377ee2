"""DuckDB SQL for the queries that SQL can tell, written apart from the operators.

Thresholds and starts are spelled out here, not imported, so that a wrong one shows.
"""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

URL_VERDICTS = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3)
                       ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '@UPPER@', '@LOWER@') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut
), rules (host_rule, path_rule, rule, said) AS (
  VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'),
         ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')
), fits AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(said, length(rule)) AS said
  FROM parts JOIN rules ON (host = host_rule OR ends_with(host, concat('.', host_rule)))
                       AND starts_with(path, path_rule)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(said, 'allow') AS verdict
FROM parts LEFT JOIN fits USING (page_id)
""".replace("@UPPER@", UPPER).replace("@LOWER@", LOWER)

RULES = {  # measure, good from, good to, bad below, bad above
    "length": ("n_words", 50, 100000, 20, 1000000),
    "word_length": ("mean_word", 3.5, 6.5, 3.0, 7.5),
    "symbols": ("symbol_share", 0.0, 0.02, -1.0, 0.1),
    "same_lines": ("dup_line_share", 0.0, 0.25, -1.0, 0.4),
    "repeats": ("repeat_share", 0.0, 0.1, -1.0, 0.3),
    "capitals": ("capital_share", 0.0, 0.1, -1.0, 0.3),
    "variety": ("distinct_share", 0.5, 1.0, 0.3, 2.0),
    "marks": ("mark_share", 0.0, 0.4, -1.0, 0.8),
}
GOOD_START, BAD_START, SHARE_START, ROUNDS = (0.09, 0.9, 0.01), (0.15, 0.65, 0.2), 0.7, 25

_MEASURES = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents
), split AS (
  SELECT *, @WORDS@ AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM docs
), windows AS (
  SELECT rid, w[i : i + 2] AS t, i FROM (
    SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) >= 3)
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM (
    SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, t) > 1
  ), (VALUES (0), (1), (2)) AS s(k) GROUP BY rid
), counts AS (
  SELECT doc_id, text, lines, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM split LEFT JOIN covered USING (rid)
), measures AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
         CASE WHEN n_words > 0 THEN word_chars / n_words END AS mean_word,
         CASE WHEN n_words > 0 THEN n_symbols / n_words END AS symbol_share,
         CASE WHEN len(lines) > 1 THEN n_dup_lines / len(lines) END AS dup_line_share,
         CASE WHEN n_words > 0 THEN n_repeat_words / n_words END AS repeat_share,
         CASE WHEN n_words > 0 THEN len(regexp_extract_all(text, '[A-Z]')) / word_chars END AS capital_share,
         CASE WHEN n_words > 0 THEN len(list_distinct(w)) / n_words END AS distinct_share,
         CASE WHEN n_words > 0 THEN len(regexp_extract_all(text, '[!-/:-@\[\]^-`{-~]')) / n_words END AS mark_share,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM counts
), voted AS (
  SELECT *, @VOTES@ FROM measures
), patterns AS MATERIALIZED (
  SELECT @NAMES@, count(*) AS n FROM voted WHERE NOT base_failed GROUP BY ALL
)
"""


def quality_votes() -> str:
    """Counts, votes and all rounds of expectation-maximisation, one pair of steps after another."""
    votes = ", ".join(
        f"CASE WHEN {c} IS NULL THEN 0 WHEN {c} < {under} OR {c} > {over} THEN 2 "
        f"WHEN {c} >= {low} AND {c} <= {high} THEN 1 ELSE 0 END AS v_{name}"
        for name, (c, low, high, under, over) in RULES.items())
    names = ", ".join(f"v_{name}" for name in RULES)
    sql = (_MEASURES.replace("@WORDS@", WORDS.format(text="text")).replace("@VOTES@", votes)
           .replace("@NAMES@", names))
    chance = "(CASE v_{r} WHEN 0 THEN {k}_{r}_0 WHEN 1 THEN {k}_{r}_1 ELSE {k}_{r}_2 END)"
    odds = " + ".join(["ln(share / (1 - share))"] + [
        f"ln({chance.format(r=r, k='g')} / {chance.format(r=r, k='b')})" for r in RULES])
    p_good = f"1.0 / (1.0 + exp(-({odds})))"
    start = ", ".join([f"CAST({SHARE_START} AS DOUBLE) AS share"] + [
        f"CAST({x} AS DOUBLE) AS {k}_{r}_{v}" for r in RULES
        for k, xs in (("g", GOOD_START), ("b", BAD_START)) for v, x in enumerate(xs)])
    sql += f", par0 AS MATERIALIZED (SELECT {start})"
    for i in range(1, ROUNDS + 1):
        sql += (f", e{i} AS MATERIALIZED (SELECT {names}, n, {p_good} AS p FROM patterns, par{i - 1})"
                f", s{i} AS MATERIALIZED (SELECT coalesce(sum(n * p), 0) + 1.0 AS g, "
                f"coalesce(sum(n) - sum(n * p), 0) + 1.0 AS b, coalesce(sum(n), 0) AS whole, " + ", ".join(
                    f"coalesce(sum(CASE WHEN v_{r} = {v} THEN n * {p} ELSE 0 END), 0) AS {k}_{r}_{v}"
                    for r in RULES for v in range(3) for k, p in (("g", "p"), ("b", "(1 - p)")))
                + f" FROM e{i}), par{i} AS MATERIALIZED (SELECT CASE WHEN whole = 0 THEN p.share "
                "ELSE g / (g + b) END AS share, " + ", ".join(
                    f"CASE WHEN whole = 0 THEN p.{k}_{r}_{v} ELSE (s.{k}_{r}_{v} + 1.0) / ({k} + 2.0) END "
                    f"AS {k}_{r}_{v}" for r in RULES for v in range(3) for k in "gb")
                + f" FROM s{i} s, par{i - 1} p)")
    return sql + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {p_good} >= 0.5 AS kept, round({p_good}, 4) AS p_good
FROM voted, par{ROUNDS}"""


def jaccard_components(words: int, percent: int) -> str:
    """Links from the join of equal shingles; components by reachability."""
    text = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    return f"""
WITH RECURSIVE split AS (
  SELECT doc_id, {WORDS.format(text=text)} AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + {words - 1}], ' ') AS s FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words - 2}, 2))) AS i FROM split
    WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= {percent} * (any_value(x.n) + any_value(y.n) - count(*))
), reach AS (
  SELECT DISTINCT a AS node, a AS seen FROM links
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen
), smallest AS (
  SELECT node, min(seen) AS root FROM reach GROUP BY node
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN smallest ON node = d.doc_id
"""
