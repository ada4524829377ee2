"""The checking SQL of the registered queries, in DuckDB's dialect.

Written from the definitions and not from the Spark plans: dense time grids instead of sparse
arithmetic, ordinary whole-history windows instead of blocks, plain joins, and every pair of
texts and names instead of blocking.
"""

from __future__ import annotations

import re

from tipscope.functions.text import (
    DAYS_PATTERN, MONTHS_PATTERN, NAME_STOP_WORDS, TARGET_PATTERN, TICKER_PATTERN, WEEKS_PATTERN,
)
from tipscope.functions.vocabulary import DEFAULT as V
from tipscope.operators.redflags import FLAGS
from tipscope.operators.resolve import ALIASES
from tipscope.operators.scoring import (
    DISCLAIMER, NO_MARKET_NOTE, NO_TICKER_NOTE,
)
from tipscope.plans.driver_tables import DUCKDB_TABLES, shape

AS_OF = "TIMESTAMP '1998-06-30 12:00:00'"
_CROWDED_AT = "TIMESTAMP '1998-03-01'"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(_q(item) for item in items) + "]"


def _t(name: str) -> str:
    return shape(name, "duckdb", DUCKDB_TABLES)


def _r(*columns: str, places: int = 6) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in columns)


PRICES = f"prices AS ({_t('DAILY_PRICES')})"
SYMBOLS = f"symbols AS ({_t('SYMBOLS')})"
MESSAGES = f"messages AS ({_t('CHANNEL_MESSAGES')})"
MENTIONS = f"mentions AS ({_t('CHANNEL_MENTIONS')})"
SCORES = f"scores AS ({_t('ORDER_SCORES')})"
KEY = "source, channel_id, message_id"

FEATURES = f"""{PRICES}, {SYMBOLS}, windowed AS (
  SELECT p.*, s.date_of_listing,
    count(*) OVER h AS n_hist, row_number() OVER o AS rn,
    close / nullif(lag(close, 5) OVER o, 0) - 1 AS runup_5d,
    close / nullif(lag(close, 10) OVER o, 0) - 1 AS runup_10d,
    close / nullif(lag(close, 20) OVER o, 0) - 1 AS runup_20d,
    count(total_traded_qty) OVER b60 AS n60, avg(total_traded_qty) OVER b60 AS m60,
    stddev_samp(total_traded_qty) OVER b60 AS s60,
    count(deliv_pct) OVER b10 AS n10, avg(deliv_pct) OVER b10 AS m10,
    sum(CASE WHEN high = low AND close > prev_close THEN 1 ELSE 0 END) OVER i10 AS uc,
    count(turnover_lacs) OVER i20 AS n20, median(turnover_lacs) OVER i20 AS med20
  FROM prices p LEFT JOIN symbols s USING (exchange, symbol, series)
  WINDOW h AS (PARTITION BY exchange, symbol, series),
    o AS (PARTITION BY exchange, symbol, series ORDER BY trade_date),
    b60 AS (PARTITION BY exchange, symbol, series ORDER BY trade_date
            ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING),
    b10 AS (PARTITION BY exchange, symbol, series ORDER BY trade_date
            ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
    i10 AS (PARTITION BY exchange, symbol, series ORDER BY trade_date
            ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
    i20 AS (PARTITION BY exchange, symbol, series ORDER BY trade_date
            ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
), features AS (
  SELECT exchange, symbol, series, trade_date, runup_5d, runup_10d, runup_20d,
    CASE WHEN n60 >= 20 AND s60 > 0 THEN (total_traded_qty - m60) / s60 END AS volume_zscore_60d,
    deliv_pct AS delivery_pct,
    CASE WHEN n10 >= 3 THEN deliv_pct - m10 END AS delivery_pct_trend_10d,
    CAST(uc AS BIGINT) AS upper_circuit_count_10d,
    CASE WHEN n20 >= 5 THEN med20 END AS trailing_median_turnover_20d,
    CASE WHEN n20 < 5 THEN NULL WHEN med20 < 100 THEN 'micro' WHEN med20 < 1000 THEN 'small'
         WHEN med20 < 10000 THEN 'mid' ELSE 'large' END AS liquidity_bucket,
    CAST(date_diff('day', date_of_listing, trade_date) AS DOUBLE) AS days_since_listing,
    is_sme
  FROM windowed WHERE n_hist >= 21
)"""
FEATURE_LIST = ("exchange, symbol, series, trade_date, "
                + _r("runup_5d", "runup_10d", "runup_20d", "volume_zscore_60d", "delivery_pct",
                     "delivery_pct_trend_10d")
                + ", upper_circuit_count_10d, " + _r("trailing_median_turnover_20d")
                + ", liquidity_bucket, days_since_listing, is_sme")
FKEY = "exchange, symbol, series, trade_date"

LABELS = """ahead AS (
  SELECT exchange, symbol, series, trade_date, close,
    list(close) OVER (PARTITION BY exchange, symbol, series ORDER BY trade_date
                      ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING) AS nxt
  FROM prices
), peaks AS (
  SELECT *, list_slice(nxt, 1, 30) AS w1, list_max(list_slice(nxt, 1, 30)) AS peak FROM ahead
), falls AS (
  SELECT *, list_slice(nxt, list_position(w1, peak) + 1, list_position(w1, peak) + 30) AS w2
  FROM peaks
), labels AS (
  SELECT exchange, symbol, series, trade_date,
    CASE WHEN close IS NULL OR close <= 0 OR peak IS NULL THEN NULL
         WHEN NOT (peak >= close * 1.25) THEN CASE WHEN len(w1) = 30 THEN 0.0::DOUBLE END
         WHEN list_min(w2) <= peak * 0.7 THEN 1.0::DOUBLE
         WHEN len(w2) = 30 THEN 0.0::DOUBLE END AS y_pump_dump
  FROM falls
)"""
DATASET = f"""{FEATURES}, {LABELS}, dataset AS (
  SELECT exchange, symbol, series, trade_date, runup_5d, runup_10d, runup_20d,
    volume_zscore_60d, delivery_pct, delivery_pct_trend_10d, upper_circuit_count_10d,
    trailing_median_turnover_20d, days_since_listing, CAST(is_sme AS INT) AS is_sme,
    CASE liquidity_bucket WHEN 'micro' THEN 0.0 WHEN 'small' THEN 1.0 WHEN 'mid' THEN 2.0
      WHEN 'large' THEN 3.0 END::DOUBLE AS liquidity_bucket,
    CAST(y_pump_dump AS INT) AS y_pump_dump
  FROM features JOIN labels USING (exchange, symbol, series, trade_date)
  WHERE y_pump_dump IS NOT NULL
)"""
DATASET_LIST = (FKEY + ", " + _r("runup_5d", "runup_10d", "runup_20d", "volume_zscore_60d",
                                 "delivery_pct", "delivery_pct_trend_10d",
                                 "trailing_median_turnover_20d")
                + ", upper_circuit_count_10d, days_since_listing, is_sme, liquidity_bucket, "
                  "y_pump_dump")
LATEST = """latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC, exchange, series)
      AS rn FROM features) WHERE rn = 1
)"""


def bursts(table: str, as_of: str, window: int = 48, baseline: int = 90, step: int = 24) -> str:
    """``stats``: burst statistics from a dense grid of sample times."""
    return f"""known AS (SELECT ticker, channel_id, posted_at FROM {table}
                         WHERE ticker IS NOT NULL),
    clock AS (SELECT {as_of} AS now),
    grid AS (SELECT k, now - INTERVAL {baseline} DAY + k * INTERVAL {step} HOUR AS t
             FROM clock, range(0, 10000) r(k)
             WHERE now - INTERVAL {baseline} DAY + k * INTERVAL {step} HOUR
                   < now - INTERVAL {window} HOUR),
    hits AS (SELECT ticker, k, count(DISTINCT channel_id) AS c
             FROM known JOIN grid ON posted_at > t - INTERVAL {window} HOUR AND posted_at <= t
             GROUP BY ticker, k),
    dense AS (SELECT ticker, coalesce(c, 0) AS c
              FROM (SELECT DISTINCT ticker FROM known) CROSS JOIN grid
              LEFT JOIN hits USING (ticker, k)),
    past AS (SELECT ticker, avg(c) AS m, stddev_pop(c) AS s FROM dense GROUP BY ticker),
    cur AS (SELECT ticker, count(DISTINCT CASE WHEN posted_at > now - INTERVAL {window} HOUR
                                    AND posted_at <= now THEN channel_id END) AS n_channels
            FROM known, clock GROUP BY ticker),
    stats AS (SELECT ticker, n_channels, m AS baseline_mean,
                CASE WHEN s > 1e-9 THEN s ELSE 0.0 END AS baseline_std,
                CASE WHEN s > 1e-9 THEN (n_channels - m) / s
                     WHEN n_channels > m THEN 'inf'::DOUBLE ELSE 0.0 END AS z
              FROM cur JOIN past USING (ticker))"""


def bursts_at_each(table: str) -> str:
    """Burst statistics at each mention's own time, from all pairs of a time and a mention."""
    return f"""known AS (SELECT ticker, channel_id, posted_at AS p FROM {table}
                         WHERE ticker IS NOT NULL),
    asked AS (SELECT DISTINCT ticker, p AS t FROM known),
    hits AS (SELECT a.ticker, a.t, k, count(DISTINCT channel_id) AS c
             FROM asked a JOIN known USING (ticker), range(-1, 88) r(k)
             WHERE p <= CASE WHEN k < 0 THEN t ELSE t - INTERVAL 90 DAY + k * INTERVAL 24 HOUR END
               AND p > CASE WHEN k < 0 THEN t ELSE t - INTERVAL 90 DAY + k * INTERVAL 24 HOUR END
                       - INTERVAL 48 HOUR
             GROUP BY a.ticker, a.t, k),
    sums AS (SELECT ticker, t, sum(CASE WHEN k < 0 THEN c ELSE 0 END) AS n_channels,
               sum(CASE WHEN k >= 0 THEN c ELSE 0 END) / 88.0 AS m,
               sum(CASE WHEN k >= 0 THEN c * c ELSE 0 END) / 88.0 AS q
             FROM hits GROUP BY ticker, t),
    spread AS (SELECT *, sqrt(greatest(q - m * m, 0.0)) AS s FROM sums),
    stats AS (SELECT ticker, t AS as_of, CAST(n_channels AS BIGINT) AS n_channels,
                m AS baseline_mean, CASE WHEN s > 1e-6 THEN s ELSE 0.0 END AS baseline_std,
                CASE WHEN s > 1e-6 THEN (n_channels - m) / s
                     WHEN n_channels > m THEN 'inf'::DOUBLE ELSE 0.0 END AS z FROM spread)"""


_STATS = ("ticker, n_channels, " + _r("baseline_mean", "baseline_std", "z")
          + ", n_channels >= 3 AND z >= 2 AS is_burst")


def _has(terms, text: str = "lower(text)") -> str:
    edge = r"[^\p{L}\p{N}_]"
    words = "|".join(re.escape(t) for t in terms if t[0].isalnum())
    tests = [f"regexp_matches({text}, {_q(f'(^|{edge})(?:{words})($|{edge})')})"]
    tests += [f"contains({text}, {_q(t)})" for t in terms if not t[0].isalnum()]
    return "(" + " OR ".join(tests) + ")"


def _number(pattern: str, end: str = "") -> str:
    return f"nullif(regexp_extract(text, {_q('(?i)' + pattern + end)}, 1), '')"


_END = r"($|[^\p{L}\p{N}_])"
TIPS = f"""
    CASE WHEN hin AND eng THEN 'mixed' WHEN hin THEN 'hi-Latn' ELSE 'en' END AS language,
    CASE WHEN up AND NOT down THEN 'long' WHEN down AND NOT up THEN 'short'
         ELSE 'unclear' END AS direction,
    CAST({_number(TARGET_PATTERN)} AS DOUBLE) AS target_price,
    coalesce(CAST({_number(DAYS_PATTERN, _END)} AS INT),
             CAST({_number(WEEKS_PATTERN, _END)} AS INT) * 7,
             CAST({_number(MONTHS_PATTERN, _END)} AS INT) * 30,
             CASE WHEN {_has(V.intraday)} THEN 1 WHEN {_has(V.positional)} THEN 5 END)
      AS horizon_days,
    CASE WHEN {_has(V.urgency_high)} THEN 'high' WHEN {_has(V.urgency_medium)} THEN 'medium'
         ELSE 'low' END AS urgency,
    {_has(V.guarantee)} AS guarantee_claim, {_has(V.insider)} AS insider_claim,
    {_has(V.disclosure)} AS disclosure_present"""


def tips(table: str) -> str:
    return f"""worded AS (
      SELECT *, regexp_extract_all(lower(text), '[a-z]+') AS words,
        {_has(V.long)} AS up, {_has(V.short)} AS down FROM {table}
    ), marked AS (
      SELECT *, list_has_any(words, {_list(V.hinglish)}) AS hin,
        len(list_filter(words, lambda w: len(w) > 1
            AND NOT list_contains({_list(V.hinglish)}, w))) > 0 AS eng FROM worded
    ), tips AS (SELECT *, {TIPS} FROM marked)"""


TIP_LIST = (KEY + ", language, direction, target_price, horizon_days, urgency, guarantee_claim, "
                  "insider_claim, disclosure_present")
_FIRES = {
    "guarantee_language": "guarantee_claim", "insider_language": "insider_claim",
    "missing_disclosure": "NOT disclosure_present", "high_urgency": "urgency = 'high'",
    "explicit_target": "target_price IS NOT NULL",
}
FLAG_SCORE = "round(least(1.0, " + " + ".join(
    f"CASE WHEN {_FIRES[f.code]} THEN {f.weight}::DOUBLE ELSE 0.0 END" for f in FLAGS) + "), 4)"
FLAG_CODES = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN {_FIRES[f.code]} THEN '{f.code}' END" for f in FLAGS
) + "], lambda x: x IS NOT NULL), ',')"


def _norm(text: str) -> str:
    words = (f"list_filter(string_split(regexp_replace(lower({text}), '[^a-z0-9]', ' ', 'g'), "
             "' '), lambda w: w <> '')")
    kept = f"list_filter({words}, lambda w: NOT list_contains({_list(NAME_STOP_WORDS)}, w))"
    return (f"array_to_string(list_sort(CASE WHEN len({kept}) > 0 THEN {kept} ELSE {words} END),"
            " ' ')")


ALIAS = ("CASE regexp_replace(lower(text), '[^a-z0-9&]', '', 'g') "
         + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in ALIASES.items()) + " END")
EXACT = f"""exact AS (
  SELECT {KEY}, min(token) AS ticker FROM (
    SELECT {KEY}, unnest(list_distinct(regexp_extract_all(text, {_q(TICKER_PATTERN)}))) AS token
    FROM messages) WHERE token IN (SELECT symbol FROM symbols)
  GROUP BY {KEY} HAVING count(*) = 1
)"""
# Longest common subsequence of all pairs by the bit-vector recurrence, one character per step.
FUZZY = f"""asked AS (SELECT DISTINCT {_norm('text')} AS query FROM messages),
names AS (SELECT DISTINCT symbol, {_norm('name')} AS nm FROM symbols),
masks AS (SELECT nm, ch, sum(1::HUGEINT << pos) AS m FROM (
            SELECT DISTINCT nm, CAST(pos AS INT) AS pos, substr(nm, CAST(pos AS INT) + 1, 1) AS ch
            FROM names, range(0, 100) r(pos) WHERE pos < length(nm)) GROUP BY nm, ch),
steps(query, nm, i, v) AS (
  SELECT query, nm, 0, (1::HUGEINT << length(nm)) - 1
  FROM asked, (SELECT DISTINCT nm FROM names)
  WHERE query <> '' AND 200.0 * least(length(query), length(nm))
        / (length(query) + length(nm)) >= 80
  UNION ALL
  SELECT s.query, s.nm, s.i + 1,
    ((v + (v & coalesce(m, 0))) | (v - (v & coalesce(m, 0)))) & ((1::HUGEINT << length(s.nm)) - 1)
  FROM steps s LEFT JOIN masks k ON k.nm = s.nm AND k.ch = substr(s.query, s.i + 1, 1)
  WHERE s.i < length(s.query)
), rated AS (
  SELECT query, symbol, max(200.0 * (length(s.nm) - bit_count(v))
                            / (length(query) + length(s.nm))) AS score
  FROM steps s JOIN names USING (nm) WHERE i = length(query) GROUP BY query, symbol
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, symbol) AS rk FROM rated
), fuzzy AS (
  SELECT a.query, a.symbol AS fuzzy, a.score AS fuzzy_score
  FROM placed a LEFT JOIN placed b ON b.query = a.query AND b.rk = 2
  WHERE a.rk = 1 AND a.score >= 86 AND a.score - coalesce(b.score, 0) >= 6
)"""
RESOLVED = f"""{MESSAGES}, {SYMBOLS}, {EXACT}, {FUZZY}, resolved AS (
  SELECT m.*, coalesce(e.ticker, {ALIAS.replace('text', 'm.text')}, f.fuzzy) AS ticker,
    CASE WHEN e.ticker IS NOT NULL THEN 100.0 WHEN {ALIAS.replace('text', 'm.text')} IS NOT NULL
         THEN 99.0 ELSE f.fuzzy_score END::DOUBLE AS ticker_score,
    CASE WHEN e.ticker IS NOT NULL THEN 'exact'
         WHEN {ALIAS.replace('text', 'm.text')} IS NOT NULL THEN 'alias'
         WHEN f.fuzzy IS NOT NULL THEN 'fuzzy' END AS ticker_method
  FROM messages m LEFT JOIN exact e USING ({KEY})
  LEFT JOIN fuzzy f ON f.query = {_norm('m.text')}
)"""
_BLANK_DATE = "strftime({d}, '%d-%b-%Y')"

CALENDAR = f"""fetches AS (
  SELECT CAST(o_orderdate AS DATE) AS day, count(*) * 100 AS bytes, min(o_orderkey) AS k
  FROM orders GROUP BY 1
), days AS (
  SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE)
    AS day FROM orders
), logged AS (
  SELECT d.day, k IS NOT NULL AND k % 19 = 0 AS cached, isodow(d.day) >= 6 AS weekend, bytes,
    CASE WHEN k % 11 = 0 THEN 404 WHEN k % 13 = 0 THEN 503 WHEN k % 17 = 0 THEN NULL
         WHEN k IS NOT NULL THEN 200 END AS code,
    CASE WHEN k % 7 = 0 THEN d.day - 1 WHEN k IS NOT NULL THEN d.day END AS inside
  FROM days d LEFT JOIN fetches f USING (day)
), calendar AS (
  SELECT day,
    CASE WHEN cached THEN 'skipped' WHEN weekend OR code = 404 THEN 'nodata'
         WHEN code IS NULL OR code <> 200 THEN 'error' WHEN inside = day THEN 'valid'
         ELSE 'nodata' END AS status,
    CASE WHEN NOT cached AND NOT weekend THEN code END AS http_code,
    CASE WHEN NOT cached AND NOT weekend THEN coalesce(bytes, 0) ELSE 0 END AS bytes,
    CASE WHEN NOT cached AND NOT weekend AND code = 200
         THEN {_BLANK_DATE.format(d='inside')} END AS internal_date,
    CASE WHEN cached THEN 'already cached' WHEN weekend THEN 'weekend'
         WHEN code = 404 THEN '404 holiday' WHEN code IS NULL THEN 'request failed'
         WHEN code <> 200 THEN 'unexpected status' WHEN inside = day THEN NULL
         ELSE 'stale/echoed content' END AS note
  FROM logged
)"""

RANKED = f"""{SCORES}, per AS (SELECT p, count(*) AS n, sum(y) AS pos FROM scores GROUP BY p),
curve AS (
  SELECT p, n, pos, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(n) OVER () AS nt,
    sum(pos) OVER () AS pt FROM per WINDOW w AS (ORDER BY p DESC)
)"""

_EDGES = [i * 0.1 for i in range(1, 10)]
_BIN = " + ".join(f"CASE WHEN p >= {edge!r}::DOUBLE THEN 1 ELSE 0 END" for edge in _EDGES)

RISK = f"""WITH RECURSIVE {RESOLVED}, {tips('resolved')},
{FEATURES.replace(SYMBOLS + ', ', '')}, {LATEST}, {bursts('resolved', AS_OF)}, joined AS (
  SELECT t.*, {FLAG_SCORE} AS rf, l.symbol IS NOT NULL AS has_features, l.runup_20d,
    coalesce(round_even(least(1.0, greatest(0.0, coalesce(l.runup_20d / 2.0 + 0.25, 0.0))), 4),
             0.0) AS p,
    CASE WHEN s.n_channels >= 3 AND s.z >= 2 THEN
      least(15, round_even(5 + 2 * CASE WHEN s.z = 'inf'::DOUBLE THEN 10.0 ELSE s.z END, 0))
    END AS pts
  FROM tips t LEFT JOIN latest l ON l.symbol = t.ticker LEFT JOIN stats s ON s.ticker = t.ticker
), valued AS (
  SELECT *, CAST(greatest(0, least(100, round_even(
      0.6::DOUBLE * p * 100.0::DOUBLE + 0.4::DOUBLE * rf * 100.0::DOUBLE + coalesce(pts, 0), 0)))
      AS INT) AS value
  FROM joined
), drivers AS (
  SELECT {KEY}, code, impact, place FROM valued, LATERAL (VALUES
    ('guarantee_language', CASE WHEN guarantee_claim THEN 12.0 END, 0),
    ('insider_language', CASE WHEN insider_claim THEN 12.0 END, 1),
    ('missing_disclosure', CASE WHEN NOT disclosure_present THEN 6.0 END, 2),
    ('high_urgency', CASE WHEN urgency = 'high' THEN 6.0 END, 3),
    ('explicit_target', CASE WHEN target_price IS NOT NULL THEN 4.0 END, 4),
    ('market_susceptibility', CASE WHEN p > 0 AND has_features
      THEN round_even(0.6::DOUBLE * p * 100.0::DOUBLE, 1) END, 5),
    ('coordination_burst', pts, 6)) d(code, impact, place) WHERE impact IS NOT NULL
), top3 AS (
  SELECT {KEY}, string_agg(code, ',' ORDER BY rk) AS drivers FROM (
    SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY impact DESC, place) AS rk
    FROM drivers) WHERE rk <= 3 GROUP BY {KEY}
)"""


def _cli_two(column: str) -> str:
    return f"printf('%.2f', {column})"


def oracle_sql() -> dict[str, str]:
    sql = {
        "typed_daily_rows": """
SELECT 'NSE' AS exchange, concat('S', l_suppkey) AS symbol,
  CASE WHEN l_suppkey % 10 = 0 THEN 'SM' ELSE 'EQ' END AS series,
  CAST(l_shipdate AS DATE) AS trade_date, l_suppkey % 10 = 0 AS is_sme, count(*) AS n_rows,
  0::BIGINT AS n_prev, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS sum_close,
  CAST(sum(l_quantity) AS BIGINT) AS sum_qty, CAST(sum(l_linenumber) AS BIGINT) AS sum_trades,
  CAST(sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity END) AS BIGINT) AS sum_deliv,
  count(CASE WHEN l_returnflag <> 'N' THEN 1 END) AS n_deliv_pct, 100.0::DOUBLE AS avg_price
FROM lineitem WHERE l_linenumber NOT IN (6, 7) GROUP BY ALL""",
        "audited_files": """
WITH lines AS (
  SELECT l_orderkey, l_linenumber, CAST(date_trunc('month', l_shipdate) AS DATE) AS day,
    (year(l_shipdate) * 12 + month(l_shipdate) - 1) % 5 AS kind,
    row(CAST(l_extendedprice AS DECIMAL(18, 2)), CAST(l_quantity AS BIGINT)) AS facts FROM lineitem
), rows AS (
  SELECT day, kind, max(facts) AS facts FROM lines GROUP BY day, kind, l_orderkey, l_linenumber
), months AS (
  SELECT day, any_value(kind) AS kind, count(*) AS n_rows, CAST(sum(facts[2]) AS BIGINT) AS sum_qty,
    CAST(sum(facts[1] + CASE WHEN kind = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS sum_close
  FROM rows GROUP BY day
), files AS (
  SELECT day, 'valid' AS status, 'own' AS content FROM months
  UNION ALL SELECT CAST(day + INTERVAL 1 MONTH AS DATE), 'nodata', 'echo' FROM months WHERE kind = 3
  UNION ALL SELECT day, 'skipped', 'own' FROM months WHERE kind = 0
  UNION ALL SELECT day, 'valid', 'revised' FROM months WHERE kind = 1
) SELECT day, count(*) AS n_files, count(*) FILTER (status = 'valid') AS n_valid,
  count(*) FILTER (status = 'nodata') AS n_nodata,
  count(*) FILTER (status = 'skipped') AS n_skipped, count(DISTINCT content) AS n_contents,
  any_value(n_rows) AS n_rows, any_value(sum_qty) AS sum_qty, any_value(sum_close) AS sum_close
FROM files LEFT JOIN months USING (day) GROUP BY day""",
        "file_ledger": """
WITH rows AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS day, l_orderkey AS o, l_linenumber AS l,
    (year(l_shipdate) * 12 + month(l_shipdate) - 1) % 5 AS kind,
    CAST(l_extendedprice AS DECIMAL(18, 2)) AS price, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q
  FROM lineitem
), priced AS (
  SELECT *, 'own' AS content, CAST(price AS VARCHAR) AS p FROM rows
  UNION ALL SELECT *, 'revised', CAST(price + 1 AS VARCHAR) FROM rows WHERE kind = 1
), files AS (
  SELECT day, kind, content, strftime(day, '%d-%b-%Y') AS internal_date,
    concat('SYMBOL,SERIES,DATE1,PREV_CLOSE,OPEN_PRICE,HIGH_PRICE,LOW_PRICE,LAST_PRICE,CLOSE_PRICE,',
           'AVG_PRICE,TTL_TRD_QNTY,TURNOVER_LACS,NO_OF_TRADES,DELIV_QTY,DELIV_PER', chr(10),
           string_agg(concat(o, '-', l, ',EQ,', strftime(day, '%d-%b-%Y'), ',-,-,-,-,-,', p, ',-,', q,
                             ',-,-,-,-', chr(10)), '' ORDER BY o, l, p, q)) AS body
  FROM priced GROUP BY day, kind, content
), delivered AS (
  SELECT day, 'valid' AS status, NULL AS note, internal_date, body FROM files
  UNION ALL SELECT CAST(day + INTERVAL 1 MONTH AS DATE), 'nodata', 'stale/echoed content',
    internal_date, body FROM files WHERE kind = 3
  UNION ALL SELECT day, 'skipped', 'already loaded', internal_date, body FROM files WHERE kind = 0
) SELECT day, status, note, CAST(strlen(body) AS BIGINT) AS bytes, internal_date,
  substr(sha256(body), 1, 12) AS sha256_12 FROM delivered""",
        "typed_symbol_master": """
SELECT 'NSE' AS exchange, concat('SUP', p_partkey) AS symbol,
  CASE WHEN p_partkey % 10 = 0 THEN 'ST' ELSE 'EQ' END AS series,
  concat(p_name, ' Limited') AS name, CAST(NULL AS VARCHAR) AS isin,
  CASE WHEN p_partkey % 2 = 0 THEN 10.0::DOUBLE END AS face_value,
  CAST(p_size AS BIGINT) AS market_lot,
  CASE WHEN p_partkey % 4 <> 0 THEN CAST(DATE '2001-01-05' + CAST(p_partkey AS INT) AS DATE) END
    AS date_of_listing,
  p_partkey % 10 = 0 AS is_sme, CASE WHEN p_partkey % 2 = 0 THEN 'main' ELSE 'second' END
    AS source_url
FROM part WHERE p_partkey % 9 <> 0""",
        "message_intake": """
SELECT 'telegram' AS source, CAST(conv_id AS VARCHAR) AS channel_id,
  CAST(turn AS VARCHAR) AS message_id,
  CAST(DATE '2024-01-01' + CAST(conv_id % 200 AS INT) AS TIMESTAMP) AS posted_at,
  CAST(length(text) AS INT) AS n_chars, length(text) BETWEEN 1 AND 4000 AS accepted
FROM conversations
WHERE conv_id % 5 <> 0 AND turn NOT IN (3, 4) AND text <> ''
  AND DATE '2024-01-01' + CAST(conv_id % 200 AS INT) >= DATE '2024-07-01' - 90""",
        "chat_updates": """
SELECT conv_id AS chat_id, text FROM conversations WHERE turn % 4 IN (0, 1) AND text <> ''""",
        "file_calendar": f"WITH {CALENDAR} SELECT * FROM calendar",
        "ingest_status_totals": f"WITH {CALENDAR} SELECT status, count(*) AS n_days "
                                "FROM calendar GROUP BY status",
        "default_ranges": """
SELECT DISTINCT CAST(o_orderdate AS DATE) AS range_end,
  CAST(CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29
       THEN make_date(year(o_orderdate) - 2, 2, 28)
       ELSE make_date(year(o_orderdate) - 2, month(o_orderdate), day(o_orderdate)) END AS DATE)
    AS range_start
FROM orders""",
        "upsert_latest": """
WITH base AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, o_totalprice, o_orderkey
              FROM orders),
stored AS (SELECT * FROM base WHERE o_orderkey % 3 <> 0
           QUALIFY row_number() OVER (PARTITION BY o_custkey, day ORDER BY o_orderkey DESC) = 1),
news AS (SELECT * FROM base WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0
         QUALIFY row_number() OVER (PARTITION BY o_custkey, day
                                    ORDER BY o_totalprice DESC, o_orderkey DESC) = 1)
SELECT * FROM news UNION ALL
SELECT * FROM stored s WHERE NOT EXISTS (
  SELECT 1 FROM news n WHERE n.o_custkey = s.o_custkey AND n.day = s.day)""",
        "serving_store": f"""WITH {FEATURES} SELECT {FEATURE_LIST} FROM features
WHERE trade_date >= (SELECT min(trade_date) FROM (
  SELECT DISTINCT trade_date FROM features ORDER BY trade_date DESC LIMIT 90))""",
        "store_summary": f"""WITH {FEATURES} SELECT count(*) AS n_rows,
  count(DISTINCT trade_date) AS n_dates, min(trade_date) AS first_date,
  max(trade_date) AS last_date FROM features
WHERE trade_date IN (SELECT DISTINCT trade_date FROM features ORDER BY trade_date DESC
                     LIMIT 90)""",
        "daily_prices": f"""WITH {PRICES} SELECT exchange, symbol, series, trade_date,
  {_r('prev_close', 'high', 'low', 'close', 'turnover_lacs', 'deliv_pct', places=8)}, total_traded_qty,
  num_trades, is_sme FROM prices""",
        "market_features": f"WITH {FEATURES} SELECT {FEATURE_LIST} FROM features",
        "runup": f"WITH {FEATURES} SELECT {FKEY}, {_r('runup_5d', 'runup_10d', 'runup_20d')} "
                 "FROM features",
        "volume_zscore": f"WITH {FEATURES} SELECT {FKEY}, {_r('volume_zscore_60d')} "
                         "FROM features",
        "delivery_trend": f"WITH {FEATURES} SELECT {FKEY}, "
                          f"{_r('delivery_pct', 'delivery_pct_trend_10d')} FROM features",
        "upper_circuit_count": f"WITH {FEATURES} SELECT {FKEY}, upper_circuit_count_10d "
                               "FROM features",
        "median_turnover_bucket": f"WITH {FEATURES} SELECT {FKEY}, "
                                  f"{_r('trailing_median_turnover_20d')}, liquidity_bucket "
                                  "FROM features",
        "listing_age": f"WITH {FEATURES} SELECT {FKEY}, days_since_listing, is_sme "
                       "FROM features",
        "latest_features": f"WITH {FEATURES}, {LATEST} SELECT {FEATURE_LIST} FROM latest",
        "forward_label": f"WITH {PRICES}, {LABELS} SELECT * FROM labels",
        "labeled_dataset": f"WITH {DATASET} SELECT {DATASET_LIST} FROM dataset",
        "joined_dataset": f"WITH {DATASET} SELECT {DATASET_LIST} FROM dataset",
        "late_channel_windows": f"""WITH {MENTIONS},
  known AS (SELECT ticker, channel_id, posted_at AS p,
              CASE WHEN CAST(channel_id AS INT) % 7 = 0 THEN 2
                   WHEN CAST(posted_at AS DATE) < DATE '1995-01-01' THEN 0
                   WHEN CAST(posted_at AS DATE) < DATE '1997-01-01' THEN 1 ELSE 2 END AS part
            FROM mentions WHERE ticker IS NOT NULL),
  placed AS (SELECT ticker, channel_id, part, CAST(day AS TIMESTAMP) + to_days(k) AS e
             FROM (SELECT *, CASE WHEN p > date_trunc('day', p) THEN CAST(p AS DATE) + 1
                                  ELSE CAST(p AS DATE) END AS day FROM known), (VALUES (0), (1)) v(k)),
  marks AS (SELECT m AS part, (SELECT max(p) FROM known WHERE part < m) - INTERVAL 2 HOUR AS mark
            FROM (VALUES (0), (1), (2), (3)) t(m)),
  judged AS (SELECT pl.*, coalesce(e <= mark, false) AS late FROM placed pl JOIN marks USING (part)),
  final AS (SELECT mark AS f FROM marks WHERE part = 3)
SELECT CASE WHEN e <= f THEN 'closed' ELSE 'open' END AS kind, ticker, e AS window_end,
  count(DISTINCT channel_id) AS n FROM judged, final WHERE NOT late GROUP BY ALL
UNION ALL SELECT 'late', ticker, e, count(*) FROM judged WHERE late GROUP BY ALL""",
        "bursts_as_posted": f"WITH crowded AS ({shape('CROWDED_MENTIONS', 'duckdb', DUCKDB_TABLES)}), "
                            f"{bursts_at_each('crowded')} SELECT as_of, {_STATS} FROM stats",
        "crowded_watchlist": f"""WITH crowded AS ({shape('CROWDED_MENTIONS', 'duckdb', DUCKDB_TABLES)}),
  {bursts('crowded', "TIMESTAMP '1998-03-01'")}
  SELECT * FROM (SELECT {_STATS} FROM stats) WHERE is_burst
  ORDER BY z DESC, n_channels DESC, ticker LIMIT 1000""",
        "features_as_posted": f"""WITH {FEATURES},
  crowded AS ({shape('CROWDED_MENTIONS', 'duckdb', DUCKDB_TABLES)}),
  asked AS (SELECT DISTINCT ticker, CAST(posted_at AS DATE) AS day FROM crowded
            WHERE ticker IS NOT NULL),
  ranked AS (SELECT a.*, f.*, row_number() OVER (
               PARTITION BY ticker, day ORDER BY trade_date DESC, exchange, series) AS rn
             FROM asked a JOIN features f ON f.symbol = a.ticker AND f.trade_date < a.day)
SELECT ticker, day, exchange, symbol, series, trade_date, {_r('runup_20d')},
  upper_circuit_count_10d, {_r('volume_zscore_60d')}, liquidity_bucket, is_sme,
  {_r('days_since_listing')} FROM ranked WHERE rn = 1""",
        "burst_stats": f"WITH {MENTIONS}, {bursts('mentions', AS_OF)} "
                       f"SELECT {_STATS} FROM stats",
        "burst_stats_latest":
            f"WITH {MENTIONS}, "
            + bursts("mentions", "(SELECT max(posted_at) FROM mentions WHERE ticker IS NOT NULL)",
                     60, 40, 36) + f" SELECT {_STATS} FROM stats",
        "burst_history": f"""WITH {MENTIONS}, days AS (
  SELECT CAST(unnest(generate_series(CAST(min(posted_at) AS DATE), CAST(max(posted_at) AS DATE)
    + 3, INTERVAL 1 DAY)) AS DATE) AS d FROM mentions
), c AS (
  SELECT ticker, d, count(DISTINCT channel_id) AS n_channels FROM mentions JOIN days
    ON posted_at > d - INTERVAL 2 DAY AND posted_at <= CAST(d AS TIMESTAMP)
  WHERE ticker IS NOT NULL GROUP BY ticker, d
), sums AS (
  SELECT a.ticker, a.d, a.n_channels, coalesce(sum(b.n_channels), 0) / 88.0::DOUBLE AS m,
    coalesce(sum(b.n_channels * b.n_channels), 0) / 88.0::DOUBLE AS q
  FROM c a LEFT JOIN c b ON b.ticker = a.ticker AND b.d BETWEEN a.d - 90 AND a.d - 3
  GROUP BY a.ticker, a.d, a.n_channels
), devs AS (SELECT *, sqrt(greatest(q - m * m, 0)) AS s FROM sums),
stats AS (
  SELECT ticker, d AS as_of, n_channels, m AS baseline_mean,
    CASE WHEN s > 1e-6 THEN s ELSE 0.0 END AS baseline_std,
    CASE WHEN s > 1e-6 THEN (n_channels - m) / s WHEN n_channels > m THEN 'inf'::DOUBLE
         ELSE 0.0 END AS z FROM devs
) SELECT as_of, {_STATS} FROM stats""",
        "watchlist": f"""WITH {MENTIONS}, {bursts('mentions', AS_OF)}
SELECT {_STATS} FROM stats WHERE n_channels >= 3 AND z >= 2
ORDER BY CASE WHEN z = 'inf'::DOUBLE THEN 1e9 ELSE z END DESC, n_channels DESC, ticker LIMIT 25""",
        "channel_windows_stream": f"""WITH {MENTIONS}, known AS (
  SELECT * FROM mentions WHERE ticker IS NOT NULL
), ends AS (
  SELECT unnest(generate_series(date_trunc('day', min(posted_at)), max(posted_at)
    + INTERVAL 3 DAY, INTERVAL 1 DAY)) AS window_end FROM known
) SELECT ticker, window_end, count(DISTINCT channel_id) AS n_channels
FROM known JOIN ends ON posted_at > window_end - INTERVAL 48 HOUR AND posted_at <= window_end
GROUP BY ticker, window_end""",
        "stream_watchlist": f"""WITH crowded AS ({shape('CROWDED_MENTIONS', 'duckdb', DUCKDB_TABLES)}),
{bursts('crowded', _CROWDED_AT)}, ends AS (
  SELECT unnest(generate_series(date_trunc('day', min(posted_at)), max(posted_at), INTERVAL 1 DAY))
    AS window_end FROM known
), counted AS (
  SELECT ticker, window_end, count(DISTINCT channel_id) AS n FROM known
  JOIN ends ON posted_at > window_end - INTERVAL 48 HOUR AND posted_at <= window_end
  WHERE window_end < (SELECT max(posted_at) - INTERVAL 2 HOUR FROM known)
  GROUP BY ticker, window_end
), rated AS (
  SELECT ticker, window_end, n, CASE WHEN s.baseline_std > 1e-9
      THEN (n - s.baseline_mean) / s.baseline_std
      WHEN n > coalesce(s.baseline_mean, 0.0) THEN 'inf'::DOUBLE ELSE 0.0 END AS z
  FROM counted LEFT JOIN stats s USING (ticker)
) SELECT ticker, window_end, n AS n_channels, round(z, 6) AS z FROM rated WHERE n >= 3 AND z >= 2
QUALIFY row_number() OVER (PARTITION BY window_end ORDER BY least(z, 1e9) DESC, n DESC, ticker) <= 5""",
        "stream_tags": f"""WITH {MESSAGES}, {SYMBOLS}, {EXACT}, {tips('messages')}
SELECT {TIP_LIST}, coalesce(e.ticker, {ALIAS}) AS ticker
FROM tips LEFT JOIN exact e USING ({KEY}) WHERE text <> ''""",
        "tip_columns": f"WITH {MESSAGES}, {tips('messages')} SELECT {TIP_LIST} FROM tips",
        "document_tip_columns": f"WITH docs AS ({_t('DOCUMENT_MESSAGES')}), {tips('docs')} "
                                f"SELECT {TIP_LIST} FROM tips",
        "red_flags": f"WITH {MESSAGES}, {tips('messages')} SELECT {KEY}, {FLAG_SCORE} "
                     f"AS red_flag_score, {FLAG_CODES} AS codes FROM tips",
        "resolve_exact": f"WITH {MESSAGES}, {SYMBOLS}, {EXACT} SELECT * FROM exact",
        "resolve_alias": f"WITH {MESSAGES} SELECT * FROM (SELECT {KEY}, {ALIAS} AS ticker "
                         "FROM messages) WHERE ticker IS NOT NULL",
        "resolve_fuzzy": f"WITH RECURSIVE {MESSAGES}, {SYMBOLS}, {FUZZY} "
                         f"SELECT query, fuzzy, {_r('fuzzy_score')} FROM fuzzy",
        "resolve_tickers": f"""WITH RECURSIVE {RESOLVED}
SELECT {KEY}, ticker, {_r('ticker_score')}, ticker_method,
  (SELECT max(name) FROM symbols s WHERE s.symbol = ticker) AS ticker_name FROM resolved""",
        "tag_mentions": f"WITH RECURSIVE {RESOLVED} SELECT {KEY}, ticker, posted_at "
                        "FROM resolved",
        "resolver_hits_by_kind": f"""WITH RECURSIVE {RESOLVED},
  meant AS ({shape('MEANT_TICKERS', 'duckdb', DUCKDB_TABLES)})
SELECT kind, count(*) AS n_cases,
  count(*) FILTER (ticker IS NOT DISTINCT FROM expected) AS "right",
  count(*) FILTER (ticker IS NOT NULL AND ticker IS DISTINCT FROM expected) AS wrong,
  count(*) FILTER (ticker IS NULL AND expected IS NOT NULL) AS missed
FROM resolved JOIN meant USING (message_id) GROUP BY kind""",
        "resolver_accuracy": f"""WITH RECURSIVE {RESOLVED}, cases AS (
  SELECT ticker, (SELECT max(symbol) FROM symbols s WHERE s.symbol = CASE
    WHEN CAST(message_id AS BIGINT) % 8 IN (0, 1, 7)
    THEN regexp_extract(text, '(SUP[0-9]{{5}})', 1) END) AS expected FROM resolved)
SELECT count(*) AS n_cases,
  round(avg(CASE WHEN ticker IS NOT DISTINCT FROM expected THEN 1.0 ELSE 0.0 END), 6)
    AS accuracy,
  count(CASE WHEN expected IS NULL AND ticker IS NOT NULL THEN 1 END) AS confident_wrong
FROM cases""",
        "risk_scores": f"""{RISK}
SELECT {KEY}, value, CASE WHEN value >= 60 THEN 'high' WHEN value >= 25 THEN 'elevated'
    ELSE 'low' END AS band,
  CASE WHEN ticker IS NULL THEN 0.5 WHEN NOT has_features THEN 0.6 ELSE 0.9 END::DOUBLE
    AS confidence, ticker, p AS model_susceptibility, rf AS message_red_flag_score,
  coalesce(drivers, '') AS drivers,
  CASE WHEN ticker IS NULL THEN {_q(NO_TICKER_NOTE)} WHEN NOT has_features
       THEN {_q(NO_MARKET_NOTE)} ELSE '' END AS notes
FROM valued LEFT JOIN top3 USING ({KEY})""",
        "advice_words_in_reasons": f"""{RISK}
SELECT 0::BIGINT AS n_advice, count(*) AS n_reasons FROM (
  SELECT row_number() OVER (PARTITION BY {KEY} ORDER BY impact DESC, place) AS rk FROM drivers)
WHERE rk <= 3""",
        "temporal_split_counts": f"""WITH {DATASET}, b1 AS (
  SELECT quantile_cont(CAST(trade_date - DATE '1970-01-01' AS DOUBLE), 0.75) AS test_start
  FROM dataset
), days AS (
  SELECT *, CAST(trade_date - DATE '1970-01-01' AS DOUBLE) AS d FROM dataset
), b2 AS (
  SELECT quantile_cont(d, 0.8) AS calib_start FROM days, b1 WHERE d < test_start - 95
), tagged AS (
  SELECT *, CASE WHEN d >= test_start THEN 'test' WHEN d < test_start - 95
    THEN CASE WHEN d >= calib_start THEN 'calib' ELSE 'train' END END AS split
  FROM days, b1, b2
) SELECT split, count(*) AS n, CAST(sum(y_pump_dump) AS BIGINT) AS positives,
  min(trade_date) AS first_date, max(trade_date) AS last_date FROM tagged GROUP BY split""",
        "date_quantiles": " UNION ALL ".join(
            f"SELECT {q}::DOUBLE AS q, round(quantile_cont(CAST(CAST(o_orderdate AS DATE) - "
            f"DATE '1970-01-01' AS DOUBLE), {q}), 6) AS day FROM orders"
            for q in (0.1, 0.5, 0.75)),
        "class_weights": f"WITH {SCORES} SELECT y, count(*) AS n_class, round((SELECT count(*) "
                         "FROM scores) / (2.0::DOUBLE * count(*)), 6) AS class_weight "
                         "FROM scores GROUP BY y",
        "dataset_counts": f"WITH {SCORES} SELECT count(*) AS n, CAST(sum(y) AS BIGINT) "
                          "AS positives, round(avg(y), 6) AS base_rate FROM scores",
        "average_precision": f"""WITH {RANKED} SELECT CAST(max(nt) AS BIGINT) AS n,
  CAST(max(pt) AS BIGINT) AS positives, round(max(pt) / max(nt), 6) AS base_rate,
  round(sum((pos / pt) * (cp / cn)), 6) AS average_precision,
  round(sum((pos / pt) * (cp / cn)) / (max(pt) / max(nt)), 6) AS lift_over_base FROM curve""",
        "roc_auc": f"""WITH {SCORES}, ranks AS (
  SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r
  FROM scores
) SELECT round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0)
  / (CAST(sum(y) AS DOUBLE) * sum(1 - y)), 6) AS roc_auc FROM ranks""",
        "brier": f"WITH {SCORES} SELECT round(avg((p - y) * (p - y)), 6) AS brier FROM scores",
        "calibration_table": f"""WITH {SCORES}, binned AS (SELECT *, {_BIN} AS bin FROM scores)
SELECT CAST(bin AS INT) AS bin, round(bin * 0.1, 6)::DOUBLE AS bin_lo,
  round((bin + 1) * 0.1, 6)::DOUBLE AS bin_hi, count(*) AS n, round(avg(p), 6) AS mean_pred,
  round(avg(y), 6) AS observed_rate FROM binned GROUP BY bin""",
        "score_distribution": f"WITH {SCORES} SELECT round(quantile_cont(p, 0.5), 6) AS p50, "
                              "round(quantile_cont(p, 0.9), 6) AS p90, "
                              "round(quantile_cont(p, 0.99), 6) AS p99, round(max(p), 6) AS max "
                              "FROM scores",
    }
    sql["daily_files"] = sql["typed_daily_rows"]
    sql["refreshed_features"] = sql["market_features"]
    sql["snapshot_upsert"] = sql["upsert_latest"].replace(
        "SELECT * FROM news UNION ALL\nSELECT * FROM stored s",
        "SELECT *, 1 AS version FROM stored UNION ALL SELECT *, 2 FROM news UNION ALL\n"
        "SELECT *, 2 FROM stored s")
    sql["score_replies"] = _replies()
    sql["name_similarity"] = _name_similarity()
    sql["explained_scores"] = _explained(
        f"{FEATURES}, {LATEST}, {bursts('crowded', _CROWDED_AT)}",
        "LEFT JOIN latest l ON l.symbol = t.ticker LEFT JOIN stats s ON s.ticker = t.ticker")
    sql["explained_scores_as_posted"] = _explained(
        f"""{FEATURES}, {bursts_at_each('crowded')}, days AS (
  SELECT DISTINCT ticker, CAST(posted_at AS DATE) AS day FROM crowded
), dated AS (
  SELECT a.ticker AS for_ticker, day, f.*, row_number() OVER (
    PARTITION BY a.ticker, day ORDER BY trade_date DESC, exchange, series) AS rn
  FROM days a JOIN features f ON f.symbol = a.ticker AND f.trade_date < a.day
)""",
        "LEFT JOIN dated l ON l.rn = 1 AND l.symbol = t.ticker "
        "AND l.day = CAST(t.posted_at AS DATE) "
        "LEFT JOIN stats s ON s.ticker = t.ticker AND s.as_of = t.posted_at")
    return sql


def _lines(*parts: str) -> str:
    """Lists of lines put together, as one text."""
    return f"array_to_string(list_concat({', '.join(parts)}), chr(10))"


def _explained(tables: str, joins: str) -> str:
    """Scores with all reasons and both layouts, with every text and number spelled out."""
    reasons = """[
    CASE WHEN guarantee_claim THEN
      {'c': 'guarantee_language', 'i': 12.0::DOUBLE, 'k': 0,
       'r': 'Message claims a guaranteed or ''sure-shot'' outcome'} END,
    CASE WHEN insider_claim THEN
      {'c': 'insider_language', 'i': 12.0::DOUBLE, 'k': 1,
       'r': 'Message claims access to insider or operator information'} END,
    CASE WHEN NOT disclosure_present THEN
      {'c': 'missing_disclosure', 'i': 6.0::DOUBLE, 'k': 2,
       'r': 'Message carries no SEBI research-analyst disclosure'} END,
    CASE WHEN urgency = 'high' THEN
      {'c': 'high_urgency', 'i': 6.0::DOUBLE, 'k': 3,
       'r': 'Message uses high-pressure, act-now urgency'} END,
    CASE WHEN target_price IS NOT NULL THEN
      {'c': 'explicit_target', 'i': 4.0::DOUBLE, 'k': 4,
       'r': 'Message states a specific price target'} END,
    CASE WHEN p > 0 AND has_features THEN
      {'c': 'market_susceptibility', 'k': 5, 'i': round_even(CAST(CAST(CAST(market AS VARCHAR)
         AS DECIMAL(22, 16)) * 10 AS DOUBLE), 0) / 10.0::DOUBLE,
       'r': concat('Scrip''s recent market behaviour resembles pump-prone setups',
         CASE WHEN len(called) > 0
              THEN concat(' (', array_to_string(list_slice(called, 1, 2), '; '), ')') ELSE '' END)}
    END,
    CASE WHEN pts IS NOT NULL THEN
      {'c': 'coordination_burst', 'i': CAST(pts AS DOUBLE), 'k': 6,
       'r': concat('Being pushed by ', n_channels,
                   ' channels within 48h — a coordinated spike versus this scrip''s baseline')} END
  ]"""
    note = ("CASE WHEN ticker IS NULL THEN 'Ticker could not be resolved — score reflects message "
            "signals only.' WHEN NOT has_features THEN 'No recent market data for this scrip — "
            "score reflects message signals only.' END")
    reply = _lines(
        """[concat('*Manipulation risk: ', value, '/100*  ', CASE band WHEN 'high' THEN '🔴 HIGH'
         WHEN 'elevated' THEN '🟠 ELEVATED' ELSE '🟢 LOW' END),
       concat('Ticker: ', coalesce(ticker, '—'), '  ·  confidence ', percent, '%')]""",
        "CASE WHEN len(top) > 0 THEN list_concat(['', 'Why:'], "
        "list_transform(top, lambda x: concat('• ', x.r))) ELSE [] END",
        "CASE WHEN note IS NULL THEN [] ELSE [concat('_(', note, ')_')] END",
        "['', concat('_', disclaimer, '_')]")
    report = _lines(
        """['Manipulation-risk score',
       concat('  Score : ', value, '/100    Band: ', upper(band), '    Confidence: ',
              printf('%.2f', percent / 100.0::DOUBLE)),
       concat('  Ticker: ', coalesce(ticker, '(unresolved)'), '    (model susceptibility ',
              printf('%.2f', round_even(round(p * 10000) / 100.0::DOUBLE, 0) / 100.0::DOUBLE),
              ' · message red-flags ', printf('%.2f', rf), ')')]""",
        "CASE WHEN len(top) > 0 THEN list_concat(['  Top reasons:'], list_transform(top, "
        "lambda x, i: concat('    ', i, '. ', x.r, '  (+', CAST(round_even(x.i, 0) AS INT), ')'))) "
        "ELSE [] END",
        "CASE WHEN note IS NULL THEN [] ELSE ['  Notes:', concat('    - ', note)] END",
        "[concat('  ', disclaimer)]")
    drivers = ("array_to_string(list_transform(top, lambda x: concat(x.c, '=', "
               "printf('%.1f', x.i))), ',')")
    return f"""WITH {MESSAGES}, {tips('messages')},
crowded AS ({shape('CROWDED_MENTIONS', 'duckdb', DUCKDB_TABLES)}), {tables},
placed AS (
  SELECT t.* EXCLUDE (posted_at), c.ticker, c.posted_at FROM tips t JOIN crowded c USING ({KEY})
), joined AS (
  SELECT t.*, {FLAG_SCORE} AS rf, l.symbol IS NOT NULL AS has_features, s.n_channels,
    coalesce(round_even(least(1.0, greatest(0.0, coalesce(l.runup_20d * 4.0 + 0.5, 0.0))), 4), 0.0)
      AS p,
    list_filter([
      CASE WHEN l.runup_20d >= 0.5 THEN 'already up sharply over the past month' END,
      CASE WHEN l.upper_circuit_count_10d >= 3 THEN 'repeated upper-circuit closes recently' END,
      CASE WHEN l.volume_zscore_60d >= 3 THEN 'unusual recent volume spike' END,
      CASE WHEN l.liquidity_bucket = 'micro' THEN 'thin, microcap-level liquidity' END,
      CASE WHEN l.is_sme THEN 'SME-segment scrip' END,
      CASE WHEN l.days_since_listing < 90 THEN 'listed recently' END
    ], lambda x: x IS NOT NULL) AS called,
    CASE WHEN s.n_channels >= 3 AND s.z >= 2 THEN least(15, CAST(round_even(
      5 + 2 * CASE WHEN s.z = 'inf'::DOUBLE THEN 10.0 ELSE s.z END, 0) AS INT)) END AS pts
  FROM placed t {joins}
), valued AS (
  SELECT *, 0.6::DOUBLE * p * 100.0::DOUBLE AS market, CAST(greatest(0, least(100, round_even(
      0.6::DOUBLE * p * 100.0::DOUBLE + 0.4::DOUBLE * rf * 100.0::DOUBLE + coalesce(pts, 0), 0)))
      AS INT) AS value,
    CASE WHEN ticker IS NULL THEN 50 WHEN NOT has_features THEN 60 ELSE 90 END AS percent,
    {note} AS note,
    'Manipulation-risk assessment of a message, not investment advice. Not a view on the security.'
      AS disclaimer
  FROM joined
), explained AS (
  SELECT *, CASE WHEN value >= 60 THEN 'high' WHEN value >= 25 THEN 'elevated' ELSE 'low' END
      AS band,
    list_transform(list_slice(list_sort(list_transform(list_filter({reasons},
      lambda x: x IS NOT NULL), lambda x: {{'o': -x.i, 'k': x.k, 'x': x}})), 1, 3),
      lambda y: y.x) AS top
  FROM valued
) SELECT {KEY}, value, band, percent / 100.0::DOUBLE AS confidence, ticker,
  p AS model_susceptibility, rf AS message_red_flag_score, {drivers} AS drivers,
  {reply} AS reply, {report} AS report FROM explained"""


def _replies() -> str:
    reasons = ", ".join(
        f"CASE WHEN {_FIRES[f.code]} THEN {{{{'r': {_q(f.reason)}, 'i': '{w:.0f}'}}}} END"
        for f, w in zip(FLAGS, (12, 12, 6, 6, 4))
    ).replace("{{", "{").replace("}}", "}")
    return f"""WITH {MESSAGES}, {tips('messages')}, scored AS (
  SELECT *, {FLAG_SCORE} AS rf,
    list_slice(list_filter([{reasons}], lambda x: x IS NOT NULL), 1, 3) AS top FROM tips
), valued AS (
  SELECT *, CAST(round_even(0.4::DOUBLE * rf * 100.0::DOUBLE, 0) AS INT) AS value FROM scored
) SELECT {KEY},
  concat('*Manipulation risk: ', value, '/100*  ',
    CASE WHEN value >= 60 THEN '🔴 HIGH' WHEN value >= 25 THEN '🟠 ELEVATED' ELSE '🟢 LOW' END,
    chr(10), 'Ticker: —  ·  confidence 50%', chr(10),
    CASE WHEN len(top) > 0 THEN concat(chr(10), 'Why:', chr(10), array_to_string(
      list_transform(top, lambda x: concat('• ', x.r)), chr(10)), chr(10)) ELSE '' END,
    '_(', {_q(NO_TICKER_NOTE)}, ')_', chr(10), chr(10), '_', {_q(DISCLAIMER)}, '_') AS reply,
  concat('Manipulation-risk score', chr(10), '  Score : ', value, '/100    Band: ',
    CASE WHEN value >= 60 THEN 'HIGH' WHEN value >= 25 THEN 'ELEVATED' ELSE 'LOW' END,
    '    Confidence: 0.50', chr(10), '  Ticker: (unresolved)    (model susceptibility 0.00',
    ' · message red-flags ', {_cli_two('rf')}, ')', chr(10),
    CASE WHEN len(top) > 0 THEN concat('  Top reasons:', chr(10), array_to_string(
      list_transform(top, lambda x, i: concat('    ', i, '. ', x.r, '  (+', x.i, ')')), chr(10)),
      chr(10)) ELSE '' END,
    '  Notes:', chr(10), '    - ', {_q(NO_TICKER_NOTE)}, chr(10), '  ', {_q(DISCLAIMER)})
    AS report
FROM valued"""


def _name_similarity() -> str:
    a = _norm("concat(x.p_name, ' ', x.p_type)")
    return f"""WITH RECURSIVE pairs AS (
  SELECT x.p_partkey AS k, {a} AS a, {_norm('y.p_name')} AS b
  FROM part x JOIN part y ON x.p_partkey = y.p_partkey + 1
), distinct_pairs AS (SELECT DISTINCT a, b FROM pairs),
masks AS (SELECT b, ch, sum(1::HUGEINT << pos) AS m FROM (
            SELECT DISTINCT b, CAST(pos AS INT) AS pos, substr(b, CAST(pos AS INT) + 1, 1) AS ch
            FROM distinct_pairs, range(0, 100) r(pos) WHERE pos < length(b)) GROUP BY b, ch),
steps(a, b, i, v) AS (
  SELECT a, b, 0, (1::HUGEINT << length(b)) - 1 FROM distinct_pairs
  UNION ALL
  SELECT s.a, s.b, s.i + 1,
    ((v + (v & coalesce(m, 0))) | (v - (v & coalesce(m, 0)))) & ((1::HUGEINT << length(s.b)) - 1)
  FROM steps s LEFT JOIN masks k ON k.b = s.b AND k.ch = substr(s.a, s.i + 1, 1)
  WHERE s.i < length(s.a)
) SELECT k, p.a, p.b, round(200.0 * (length(p.b) - bit_count(v))
    / (length(p.a) + length(p.b)), 6) AS ratio
FROM pairs p JOIN steps s ON s.a = p.a AND s.b = p.b AND s.i = length(p.a)"""
