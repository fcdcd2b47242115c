"""The queries in DuckDB SQL."""

from __future__ import annotations

from tidemark.functions.text import DEGREES, NEGATIONS, POLARITY, TURNED
from tidemark.queries import EVENT_POLARITY

PRICES = "px AS (SELECT user_id::VARCHAR AS ticker, ts::DATE AS date, avg(value) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY ALL)"
CAL = "cal AS (SELECT date, (row_number() OVER (ORDER BY date) - 1)::BIGINT AS idx, lag(date) OVER (ORDER BY date) AS prev_session, lead(date) OVER (ORDER BY date) AS next_session FROM (SELECT DISTINCT date FROM px))"
BASE = """
raw AS (SELECT px.*, cal.prev_session, cal.next_session, lag(px.date) OVER w AS prev_date, lag(close) OVER w AS prev_close,
  lead(px.date) OVER w AS next_date, lead(close) OVER w AS next_adj, lead(volume) OVER w AS next_volume,
  CASE WHEN count(*) OVER f = 5 THEN median(close * volume) OVER f END AS med_dollar_vol
  FROM px JOIN cal ON px.date = cal.date
  WINDOW w AS (PARTITION BY ticker ORDER BY px.date), f AS (PARTITION BY ticker ORDER BY px.date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
nr AS (SELECT *, CASE WHEN next_date = next_session AND volume > 0 AND next_volume > 0 AND close > 0 AND next_adj > 0
  AND next_adj / close BETWEEN 0.25 AND 4 THEN next_adj / close - 1 END AS ret_next,
  coalesce(prev_date = prev_session AND prev_close >= 0 AND med_dollar_vol IS NOT NULL, false) AS base_ok FROM raw)"""
RET = """
rk AS (SELECT *, row_number() OVER (PARTITION BY date, base_ok ORDER BY med_dollar_vol DESC, ticker) AS r FROM nr),
el AS (SELECT *, base_ok AND r <= 80 AND ret_next IS NOT NULL AS eligible FROM rk),
ret AS (SELECT ticker, date, ret_next, CASE WHEN eligible THEN ret_next - avg(ret_next) FILTER (eligible) OVER (PARTITION BY date) END AS ret_next_excess,
  eligible, med_dollar_vol, CASE WHEN eligible THEN ceil(3.0 * row_number() OVER (PARTITION BY date, eligible ORDER BY med_dollar_vol DESC, ticker)
  / count(*) OVER (PARTITION BY date, eligible))::INT END AS liquidity_tercile FROM el)"""
SC = "sc AS (SELECT px.ticker, px.date AS signal_date, -px.close AS score, ret.ret_next_excess, ret.liquidity_tercile FROM px JOIN ret USING (ticker, date) WHERE eligible)"
ALL = ",".join([PRICES, CAL, BASE, RET])
SCORES = ALL + "," + SC
LI = """li AS (SELECT l_suppkey::VARCHAR AS ticker, l_shipdate::DATE AS signal_date, round(avg(l_extendedprice / l_quantity), 6) AS score,
  round(avg(l_discount) - 0.05, 9) AS ret_next_excess, year(l_shipdate::DATE)::INT AS test_year FROM lineitem GROUP BY ALL)"""


def ic(src: str, ret: str = "ret_next_excess", key: str = "", names: int = 20, name: str = "ic") -> str:
    k = f"{key}, " if key else ""
    return f"""
{name}r AS (SELECT *, rank() OVER (PARTITION BY {k}signal_date ORDER BY score) + (count(*) OVER (PARTITION BY {k}signal_date, score) - 1) / 2 AS ra,
  rank() OVER (PARTITION BY {k}signal_date ORDER BY {ret}) + (count(*) OVER (PARTITION BY {k}signal_date, {ret}) - 1) / 2 AS rb FROM {src}),
{name} AS (SELECT {k}signal_date, corr(ra, rb) AS ic, count(*) AS n FROM {name}r GROUP BY {k}signal_date
  HAVING count(*) >= {names} AND min(score) < max(score) AND min({ret}) < max({ret}))"""


def legs(src: str, key: str = "", names: int = 20, keep: str = "WHERE q IN (1, 5)") -> str:
    k = f"{key}, " if key else ""
    return f"""
qn AS (SELECT *, count(*) OVER w AS n, min(score) OVER w AS lo, max(score) OVER w AS hi,
  row_number() OVER (PARTITION BY {k}signal_date ORDER BY score, md5(ticker || signal_date::VARCHAR)) AS r FROM {src} WINDOW w AS (PARTITION BY {k}signal_date)),
qq AS (SELECT *, ceil(5.0 * r / n)::INT AS q FROM qn WHERE n >= {names} AND lo < hi),
lg AS (SELECT *, CASE WHEN q = 5 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END / count(*) OVER (PARTITION BY {k}signal_date, q) AS w FROM qq {keep})"""


def ls(src: str, key: str = "", names: int = 20) -> str:
    k, part = (f"{key}, ", f"PARTITION BY {key} ") if key else ("", "")
    both = lambda a, b: f"AND {a}.{key} = {b}.{key}" if key else ""
    col = f"coalesce(a.{key}, b.{key}) AS {key}, " if key else ""
    return f"""{legs(src, key, names)},
dt AS (SELECT *, lead(signal_date) OVER ({part}ORDER BY signal_date) AS nx FROM (SELECT DISTINCT {k}signal_date FROM lg)),
pv AS (SELECT {"lg." + key + ", " if key else ""}nx AS signal_date, ticker, w FROM lg JOIN dt ON lg.signal_date = dt.signal_date {both("lg", "dt")} WHERE nx IS NOT NULL),
tn AS (SELECT {k}signal_date, sum(d) AS turnover FROM (SELECT {col}coalesce(a.signal_date, b.signal_date) AS signal_date, abs(coalesce(a.w, 0) - coalesce(b.w, 0)) AS d
  FROM lg a FULL JOIN pv b ON a.signal_date = b.signal_date AND a.ticker = b.ticker {both("a", "b")}) GROUP BY {k}signal_date),
gr AS (SELECT {k}signal_date, sum(w * ret_next_excess) AS gross FROM lg GROUP BY {k}signal_date),
lsd AS (SELECT gr.*, turnover, 0.001 * turnover AS cost, gross - 0.001 * turnover AS net FROM gr JOIN tn ON gr.signal_date = tn.signal_date {both("gr", "tn")})"""


def nw(src: str, key: str = "", name: str = "nw") -> str:
    k, part = (f"{key}, ", f"PARTITION BY {key} ") if key else ("", "")
    terms = " + ".join(f"2 * (1 - {lag}/6.0) * e * coalesce(lag(e, {lag}) OVER (ORDER BY signal_date), 0)" if not key else f"2 * (1 - {lag}/6.0) * e * coalesce(lag(e, {lag}) OVER (PARTITION BY {key} ORDER BY signal_date), 0)" for lag in range(1, 6))
    group = f"GROUP BY {key}" if key else ""
    return f"""
{name}e AS (SELECT *, ic - avg(ic) OVER ({part}) AS e FROM {src}), {name}w AS (SELECT *, e * e + {terms} AS v FROM {name}e),
{name} AS (SELECT {k}count(*) AS days, avg(ic) AS mean, avg(ic) / sqrt(sum(v) / (count(*) * count(*))) AS t FROM {name}w {group})"""


def summary(src: str, ctes: str, key: str = "", names: int = 20, alias: str = "") -> str:
    k = f"{key}, " if key else ""
    group = f"GROUP BY {key}" if key else ""
    join = f"FULL JOIN p USING ({key})" if key else "CROSS JOIN p"
    out = f"{key} AS {alias or key}, " if key else ""
    return f"""WITH {ctes},{ic(src, key=key, names=names)},{nw("ic", key)},{ls(src, key, names)},
p AS (SELECT {k}avg(net) / stddev_samp(net) * sqrt(252) AS net_sharpe, avg(gross) / stddev_samp(gross) * sqrt(252) AS gross_sharpe, avg(turnover) AS mean_turnover FROM lsd {group})
SELECT {out}coalesce(days, 0)::BIGINT AS days, round(mean, 8) AS mean_ic, round(CASE WHEN days > 6 THEN t END, 6) AS ic_t, round(net_sharpe, 6) AS net_sharpe,
  round(gross_sharpe, 6) AS gross_sharpe, round(mean_turnover, 8) AS mean_turnover FROM nw {join}"""


def asof(early: bool) -> str:
    cut = "CASE WHEN date = DATE '2024-01-10' THEN INTERVAL 770 MINUTE ELSE INTERVAL 950 MINUTE END" if early else "INTERVAL 950 MINUTE"
    return f"""WITH {PRICES}, k AS (SELECT date, date + {cut} + INTERVAL 5 HOUR AS cut FROM (SELECT DISTINCT date FROM px) WHERE day(date) % 3 = 1)
SELECT event_id, k.date::DATE AS signal_date FROM events e ASOF LEFT JOIN k ON e.ts < k.cut"""


def panel(same_day: bool) -> str:
    if same_day:
        src = "SELECT ret.ticker, next_session AS signal_date, ret_next_excess FROM ret JOIN cal USING (date) WHERE eligible AND next_session IS NOT NULL"
        when = "(ts - INTERVAL 5 HOUR)::DATE"
        news = f"SELECT user_id::VARCHAR AS ticker, {when} AS signal_date FROM events"
    else:
        src = "SELECT ticker, date AS signal_date, ret_next_excess FROM ret WHERE eligible"
        news = "SELECT user_id::VARCHAR AS ticker, k.date AS signal_date FROM events e ASOF JOIN (SELECT date, date + INTERVAL 1250 MINUTE AS cut FROM cal) k ON e.ts < k.cut"
    return f"WITH {ALL}, r AS ({src}), nw AS ({news}), pn AS (SELECT * FROM nw JOIN r USING (ticker, signal_date)) "


STAMPS = """st AS (SELECT CASE WHEN event_id % 5 = 0 THEN strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d') || ' 00:00:00' ELSE strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') END AS wall,
  CASE WHEN event_id % 7 = 0 THEN '+00:00' WHEN event_id % 11 = 0 THEN '' ELSE '-05:00' END AS off FROM events)"""
TERMS = r"tk AS (SELECT doc_id AS row_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')) AS term FROM documents), tc AS (SELECT row_id, term, count(*) AS tf FROM tk GROUP BY ALL)"
VOCAB = "vc AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS total, ln((1.0 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tc GROUP BY term HAVING count(*) >= 5 ORDER BY total DESC, term LIMIT 50000)"


def _values(name: str, values) -> str:
    return f"{name}(term, v) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in sorted(values.items())) + ")"


_NOT = ", ".join(f"'{w}'" for w in NEGATIONS)
LEXICON = rf"""{_values("lx", POLARITY)}, {_values("dg", DEGREES)},
ws AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM documents),
ps AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS i FROM ws),
nb AS (SELECT *, lag(term, 1) OVER k AS b1, lag(term, 2) OVER k AS b2, lag(term, 3) OVER k AS b3 FROM ps WINDOW k AS (PARTITION BY doc_id ORDER BY i)),
lv AS (SELECT doc_id, (lx.v + sign(lx.v) * coalesce(dg.v, 0)) * CASE WHEN coalesce(b1 IN ({_NOT}), false) OR coalesce(b2 IN ({_NOT}), false) OR coalesce(b3 IN ({_NOT}), false) THEN {TURNED} ELSE 1 END AS v FROM nb JOIN lx USING (term) LEFT JOIN dg ON dg.term = b1)"""
SUBSET = "SELECT ticker, signal_date, floor(score / 50)::DOUBLE AS score, ret_next_excess, liquidity_tercile FROM sc"


SHUFFLED = """lb AS (SELECT o_orderkey AS row_id, (o_totalprice > 200000)::INT AS y FROM orders), p AS (SELECT row_id, row_number() OVER (ORDER BY md5(row_id || ':0'), row_id) AS i FROM lb),
g AS (SELECT y, row_number() OVER (ORDER BY md5(row_id || ':1000003'), row_id) AS i FROM lb), sh AS (SELECT row_id, y FROM p JOIN g USING (i))"""


def oracle_sql() -> dict[str, str]:
    study = f"""WITH {SCORES},{legs("sc", keep="")}, k AS (SELECT unnest([-1, 0, 1, 2, 3, 4, 5])::INT AS "offset"),
m AS (SELECT q, "offset", avg(ret.ret_next_excess) AS mean_r FROM lg JOIN cal c ON lg.signal_date = c.date CROSS JOIN k JOIN cal c2 ON c2.idx = c.idx + "offset"
  JOIN ret ON ret.ticker = lg.ticker AND ret.date = c2.date AND eligible GROUP BY ALL),
es AS (SELECT q, "offset", mean_r, sum(mean_r) OVER (PARTITION BY q ORDER BY "offset") AS cum_r FROM m) """
    return {
        "trading_calendar": f"WITH {PRICES} SELECT date FROM px GROUP BY date HAVING count(*) >= 11",
        "calendar_neighbours": f"WITH {PRICES}, {CAL} SELECT * FROM cal",
        "rolling_median_dollar_volume": f"WITH {PRICES}, {CAL}, {BASE} SELECT ticker, date, round(med_dollar_vol, 6) AS med_dollar_vol FROM nr WHERE med_dollar_vol IS NOT NULL",
        "next_day_returns": f"WITH {PRICES}, {CAL}, {BASE} SELECT ticker, date, round(ret_next, 8) AS ret_next FROM nr WHERE ret_next IS NOT NULL",
        "universe_topk": f"WITH {ALL} SELECT ticker, date FROM ret WHERE eligible",
        "market_excess": f"WITH {ALL} SELECT ticker, date, round(ret_next_excess, 8) AS ret_next_excess FROM ret WHERE eligible",
        "liquidity_terciles": f"WITH {ALL} SELECT ticker, date, liquidity_tercile AS tercile FROM ret WHERE eligible",
        "build_returns_full": f"WITH {ALL} SELECT ticker, date, round(ret_next, 8) AS ret_next, round(ret_next_excess, 8) AS ret_next_excess, eligible, round(med_dollar_vol, 6) AS med_dollar_vol, liquidity_tercile FROM ret",
        "signal_date_asof": asof(False),
        "signal_date_early_close": asof(True),
        "panel_next_day": panel(False) + "SELECT ticker, signal_date, count(*) AS n, max((ret_next_excess > 0)::INT) AS y, round(max(ret_next_excess), 8) AS excess FROM pn GROUP BY ALL",
        "panel_same_day": panel(True) + "SELECT ticker, signal_date, count(*) AS n, max((ret_next_excess > 0)::INT) AS y, round(max(ret_next_excess), 8) AS excess FROM pn GROUP BY ALL",
        "panel_row_ids": panel(False) + ", o AS (SELECT signal_date, count(*) AS ids FROM pn GROUP BY ALL) SELECT signal_date, (sum(ids) OVER (ORDER BY signal_date) - ids)::BIGINT AS first_id, (sum(ids) OVER (ORDER BY signal_date) - 1)::BIGINT AS last_id, ids FROM o",
        "news_dedup": "SELECT DISTINCT 'U' || user_id AS ticker, ts::DATE AS day, event_type AS headline FROM events",
        "year_block_embargo": f"WITH {LI} SELECT test_year, count(*) AS n, max(signal_date) AS last_day FROM li WHERE test_year BETWEEN 1996 AND 1998 AND signal_date <> (SELECT max(signal_date) FROM li WHERE test_year BETWEEN 1996 AND 1998) GROUP BY test_year",
        "stock_day_scores": "SELECT user_id::VARCHAR AS ticker, ts::DATE AS signal_date, round(avg(value), 8) AS score, 0.5::DOUBLE AS ret_next_excess, 1 AS liquidity_tercile FROM events GROUP BY ALL",
        "daily_rank_ic": f"WITH {SCORES},{ic('sc')} SELECT signal_date, round(ic, 8) AS ic, n FROM ic",
        "lag_ic": f"WITH {SCORES}, lagged AS (SELECT sc.signal_date, sc.ticker, score, ret.ret_next_excess AS ret_lag FROM sc JOIN cal ON sc.signal_date = cal.date JOIN ret ON ret.ticker = sc.ticker AND ret.date = cal.next_session AND eligible),{ic('lagged', 'ret_lag')} SELECT signal_date, round(ic, 8) AS ic, n FROM ic",
        "quintiles_hash_ties": f"WITH {SCORES}, s2 AS ({SUBSET}),{legs('s2', keep='')} SELECT ticker, signal_date, q FROM lg",
        "long_short_daily": f"WITH {SCORES},{ls('sc')} SELECT signal_date, round(gross, 8) AS gross, round(turnover, 8) AS turnover, round(cost, 8) AS cost, round(net, 8) AS net FROM lsd",
        "turnover_full_outer": f"WITH {SCORES},{ls('sc')} SELECT signal_date, round(turnover, 8) AS turnover FROM tn",
        "event_study": study + 'SELECT q, "offset", round(mean_r, 8) AS mean_r, round(cum_r, 8) AS cum_r FROM es',
        "event_study_pivot_bps": study + 'SELECT "offset", ' + ", ".join(f"round(max(cum_r * 1e4) FILTER (q = {q}), 4) AS q{q}" for q in range(1, 6)) + ' FROM es GROUP BY "offset"',
        "newey_west_t": f"WITH {SCORES},{ic('sc')},{nw('ic')} SELECT days, round(mean, 8) AS mean, round(t, 6) AS t FROM nw",
        "annualised_sharpe": f"WITH {SCORES},{ls('sc')} SELECT round(avg(net) / stddev_samp(net) * sqrt(252), 6) AS net_sharpe, round(avg(gross) / stddev_samp(gross) * sqrt(252), 6) AS gross_sharpe FROM lsd",
        "return_moments": f"WITH {SCORES},{ls('sc')}, c AS (SELECT net, net - avg(net) OVER () AS e FROM lsd) SELECT count(*) AS n, round(avg(net), 8) AS mean, round(stddev_samp(net), 8) AS sd, round(avg(e**3) / avg(e**2)**1.5, 6) AS skew, round(avg(e**4) / avg(e**2)**2, 6) AS kurt FROM c",
        "summary_by_tercile": summary("sc", SCORES, "liquidity_tercile", 5, "tercile"),
        "summary_by_year": summary("li", LI, "test_year", 10),
        "summary_overall": summary("sc", SCORES),
        "config_sharpe_variance": "SELECT round(var_samp(sr), 10) AS sr_var FROM (SELECT avg(l_discount - l_tax) / stddev_samp(l_discount - l_tax) AS sr FROM lineitem GROUP BY l_linenumber)",
        "best_config": "SELECT (config - 1)::INT AS best_config FROM (SELECT l_linenumber AS config, round(avg(l_discount), 9) AS ic FROM lineitem GROUP BY l_linenumber, year(l_shipdate)) GROUP BY config ORDER BY avg(ic) DESC, config LIMIT 1",
        "names_per_day_gate": "SELECT count(*) AS qualifying_days FROM (SELECT ts::DATE FROM events GROUP BY ts::DATE HAVING count(DISTINCT user_id) >= 20)",
        "midnight_share": f"WITH {STAMPS} SELECT round(avg((wall LIKE '% 00:00:00')::INT), 9) AS midnight_share FROM st",
        "offset_value_counts": f"WITH {STAMPS} SELECT off AS utc_offset, count(*) AS n FROM st WHERE off <> '' GROUP BY off",
        "dst_agreement": f"WITH {STAMPS} SELECT round(avg((off = '-05:00')::INT), 9) AS agreement FROM st",
        "label_shuffle_rows": f"WITH {SHUFFLED} SELECT row_id, y FROM sh",
        "label_shuffle_counts": f"WITH {SHUFFLED} SELECT lb.y, sh.y AS shuffled, count(*) AS n FROM lb JOIN sh USING (row_id) GROUP BY ALL",
        "seeded_sample": "SELECT doc_id FROM (SELECT DISTINCT doc_id FROM documents) ORDER BY md5(doc_id || ':0'), doc_id LIMIT 100",
        "publish_conditions": f"""WITH s AS ({summary("li", LI, "test_year", 10)}), c AS (SELECT test_year, ic_t, net_sharpe, mean_ic, mean_turnover / 100 AS lag, gross_sharpe AS held FROM s)
SELECT test_year, '1_ic_t_ge_2' AS condition, ic_t AS value, coalesce(ic_t >= 2, false) AS pass FROM c UNION ALL SELECT test_year, '2_net_sharpe_ge_0_5', net_sharpe, coalesce(net_sharpe >= 0.5, false) FROM c
UNION ALL SELECT test_year, '3_lag_ic_le_half', lag, coalesce(mean_ic > 0 AND lag <= mean_ic * 0.5, false) FROM c UNION ALL SELECT test_year, '4_holdout_ic_gt_0', held, coalesce(held > 0, false) FROM c""",
        # the normal quantiles at 1 - 1/6 and 1 - 1/(6 e), and Euler's constant
        "deflated_sharpe_z": f"""WITH {SCORES},{ls('sc')}, c AS (SELECT net, net - avg(net) OVER () AS e FROM lsd),
m AS (SELECT count(*) AS n, avg(net) / stddev_samp(net) AS sr, avg(e**3) / avg(e**2)**1.5 AS skew, avg(e**4) / avg(e**2)**2 AS kurt, (0.1::DOUBLE * ((1 - 0.5772156649015329::DOUBLE) * 0.967421566101701::DOUBLE + 0.5772156649015329::DOUBLE * 1.543842550450144::DOUBLE)) AS sr0 FROM c)
SELECT n, round(sr, 8) AS sr, round(sr0, 8) AS sr0, round((sr - sr0) * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr), 6) AS z FROM m""",
        "embedding_blocks": """WITH b(block, first, last) AS (VALUES (1996, 1994, 1996), (1997, 1995, 1997), (1998, 1996, 1998), (2000, 1995, 1998)),
y AS (SELECT year(o_orderdate)::INT AS year, count(DISTINCT o_orderpriority) AS t, count(*) AS r FROM orders GROUP BY 1)
SELECT block, coalesce(sum(t), 0)::BIGINT AS distinct_texts, coalesce(sum(r), 0)::BIGINT AS rows FROM b LEFT JOIN y ON year BETWEEN first AND last GROUP BY block""",
        "hit_rate": f"WITH {SCORES} SELECT round(avg(((score + 50 > 0) = (ret_next_excess > 0))::INT), 9) AS hit_rate FROM sc",
        "year_unique_headlines": "SELECT year(o_orderdate)::INT AS year, count(DISTINCT o_orderpriority) AS distinct_texts, count(*) AS rows FROM orders GROUP BY 1",
        "feed_explode_relevance": "SELECT user_id::VARCHAR AS ticker, count(*) AS n, min(date_trunc('second', ts) + INTERVAL 5 HOUR)::TIMESTAMP AS first_ts FROM events WHERE event_id % 10 >= 5 GROUP BY user_id",
        "tfidf_vocab": f"WITH {TERMS}, {VOCAB} SELECT term, df, total, round(idf, 8) AS idf FROM vc",
        "tfidf_weights": f"WITH {TERMS}, {VOCAB}, r AS (SELECT row_id, term, tf, (1 + ln(tf)) * idf AS w FROM tc JOIN vc USING (term)) SELECT row_id, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY row_id)), 7) AS weight FROM r",
        "tfidf_bigrams": r"WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS w FROM documents), g AS (SELECT doc_id, unnest(w) AS term FROM d UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS total FROM g GROUP BY term HAVING count(DISTINCT doc_id) >= 20 ORDER BY total DESC, term LIMIT 50000",
        "lexicon_scores": f"WITH {LEXICON}, s AS (SELECT doc_id, coalesce(sum(v), 0)::DOUBLE AS t FROM documents LEFT JOIN lv USING (doc_id) GROUP BY doc_id) SELECT doc_id AS row_id, round(t / sqrt(t * t + 15), 8) AS score FROM s",
        "event_lexicon_scores": f"WITH {_values('lx', EVENT_POLARITY)}, s AS (SELECT user_id::VARCHAR AS ticker, ts::DATE AS signal_date, coalesce(v, 0)::DOUBLE AS t FROM events LEFT JOIN lx ON event_type = term) SELECT ticker, signal_date, round(avg(t / sqrt(t * t + 15)), 8) AS score, 0.0::DOUBLE AS ret_next_excess, 1 AS liquidity_tercile FROM s GROUP BY ALL",
        "standardise_embeddings": "SELECT place, round(avg(x), 6) AS mean, round(CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END, 6) AS scale FROM (SELECT (unnest(range(64)))::INT AS place, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY place",
        "mean_pool_embeddings": "SELECT label, place, round(sum(x * (vec_id % 2)) / greatest(sum(vec_id % 2), 1), 7) AS value FROM (SELECT label, vec_id, unnest(range(64))::INT AS place, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, place",
    }
