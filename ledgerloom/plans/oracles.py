"""The queries in SQL for DuckDB."""

from __future__ import annotations

from ledgerloom.config import FORMATS
from ledgerloom.plans.queries import ABLATION, CUTOFF, MODEL_COLUMNS, SCORES
from ledgerloom.sources.fixture import ACCOUNTS, CLOSES, LEDGER

_NAMES = {"events": "events", "customer": "customer"}
_BASE = f"""ledger AS ({LEDGER.format(**_NAMES)}), accounts AS ({ACCOUNTS.format(**_NAMES)}), fx_raw AS ({CLOSES.format(**_NAMES)}),
fx AS (SELECT date, currency, coalesce(last_value(close_rate IGNORE NULLS) OVER (PARTITION BY currency ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(close_rate IGNORE NULLS) OVER (PARTITION BY currency ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS rate FROM fx_raw),
converted AS (SELECT l.*, CAST(timestamp AS DATE) AS tx_date, amount_sent_c * rate AS adj_sent FROM ledger AS l LEFT JOIN fx ON payment_currency = currency AND CAST(timestamp AS DATE) = date),
resolved AS (SELECT tx_id, timestamp AS ts, tx_date, s.entity_id AS source, t.entity_id AS target, adj_sent, is_laundering, payment_currency, payment_format, event_type
    FROM converted JOIN accounts AS s ON from_account = s.account_number JOIN accounts AS t ON to_account = t.account_number),
bounds AS (SELECT min(tx_date) AS lo, max(tx_date) AS hi FROM resolved)"""


def _calendar(size: int = 3, stride: int = 1) -> str:
    return f"""cal AS (SELECT CAST(row_number() OVER (ORDER BY s) - 1 AS BIGINT) AS window_id, s AS window_start, CAST(s + INTERVAL {size} DAY AS DATE) AS window_end
    FROM (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL {stride} DAY)) AS DATE) AS s, hi FROM bounds) WHERE s + INTERVAL {size} DAY <= hi + INTERVAL 1 DAY)"""


_WINDOWS = f"{_BASE}, {_calendar()}, tw AS (SELECT r.*, window_id, window_start, window_end FROM resolved AS r JOIN cal ON tx_date >= window_start AND tx_date < window_end)"
_E = "SELECT window_id, window_start, window_end, source, target, sum(adj_sent) AS volume, count(*) AS count, coalesce(stddev_samp(epoch(ts)), 0) AS time_variance FROM tw"
_EDGES = f"{_WINDOWS}, edges AS ({_E} GROUP BY ALL)"


def _formats(side: str) -> str:
    return ", ".join(f"CAST(count(*) FILTER (payment_format = '{n}') AS BIGINT) AS {p}_count_{side}" for n, p in FORMATS.items())


_SENT = f"sent AS (SELECT window_id, source AS entity_id, count(DISTINCT target) AS out_degree, sum(adj_sent) AS vol_sent, count(*) AS tx_count_sent, coalesce(stddev_samp(epoch(ts)), 0) AS time_variance, count(DISTINCT payment_currency) AS distinct_currencies_sent, {_formats('sent')} FROM tw GROUP BY ALL)"
_RECV = f"recv AS (SELECT window_id, target AS entity_id, count(DISTINCT source) AS in_degree, sum(adj_sent) AS vol_recv, count(*) AS tx_count_recv, count(DISTINCT payment_currency) AS distinct_currencies_recv, {_formats('recv')} FROM tw GROUP BY ALL)"
_FRAUD = "fraud AS (SELECT window_id, entity_id, max(is_laundering) AS is_fraud FROM (SELECT window_id, source AS entity_id, is_laundering FROM tw UNION ALL SELECT window_id, target, is_laundering FROM tw) GROUP BY ALL)"


def _fan(name: str, own: str, other: str) -> str:
    return f"{name} AS (SELECT window_id, entity_id, max(n) AS {name} FROM (SELECT {own} AS entity_id, tx_date, count(DISTINCT {other}) AS n FROM resolved GROUP BY ALL) JOIN cal ON tx_date >= window_start AND tx_date < window_end GROUP BY ALL)"


_FANS = _fan("temporal_fan_out_count", "source", "target") + ", " + _fan("temporal_fan_in_count", "target", "source")
_COUNTS = ", ".join(f"coalesce({p}_count_{s}, 0) AS {p}_count_{s}" for p in FORMATS.values() for s in ("sent", "recv"))
_NODES = f"""{_WINDOWS}, {_SENT}, {_RECV}, {_FRAUD}, {_FANS},
nodes AS (SELECT window_id, strftime(window_start, '%Y-%m-%d') AS window_start, strftime(window_end, '%Y-%m-%d') AS window_end, entity_id,
    coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) + coalesce(in_degree, 0) AS degree,
    round(coalesce(vol_sent, 0), 6) AS vol_sent, round(coalesce(vol_recv, 0), 6) AS vol_recv, coalesce(tx_count_sent, 0) + coalesce(tx_count_recv, 0) AS tx_count, round(coalesce(time_variance, 0), 3) AS time_variance,
    coalesce(distinct_currencies_sent, 0) AS distinct_currencies_sent, coalesce(distinct_currencies_recv, 0) AS distinct_currencies_recv, {_COUNTS}, coalesce(is_fraud, 0) AS is_fraud,
    coalesce(temporal_fan_out_count, 0) AS temporal_fan_out_count, coalesce(temporal_fan_in_count, 0) AS temporal_fan_in_count
    FROM sent FULL JOIN recv USING (window_id, entity_id) JOIN cal USING (window_id) LEFT JOIN fraud USING (window_id, entity_id) LEFT JOIN temporal_fan_out_count USING (window_id, entity_id) LEFT JOIN temporal_fan_in_count USING (window_id, entity_id))"""

_G = "window_id, algorithm"
_LONG = f"SELECT window_id, entity_id, is_fraud, algorithm, score FROM (SELECT window_id, entity_id, is_fraud, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in SCORES)} FROM nodes) UNPIVOT (score FOR algorithm IN ({', '.join(SCORES)}))"
_SCORES = f"""{_NODES}, scores AS MATERIALIZED ({_LONG}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {_G} ORDER BY score DESC, entity_id) AS rank, count(*) OVER (PARTITION BY {_G}) AS n, sum(is_fraud) OVER (PARTITION BY {_G}) AS positives FROM scores),
curve AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY {_G}) AS pos, sum(q) OVER (PARTITION BY {_G}) AS neg FROM (SELECT {_G}, score, sum(is_fraud) AS p, sum(1 - is_fraud) AS q FROM scores GROUP BY ALL) WINDOW w AS (PARTITION BY {_G} ORDER BY score DESC)),
auc AS (SELECT {_G}, CASE WHEN max(pos) > 0 AND max(neg) > 0 THEN sum(q * (tp - p / 2.0)) / (max(pos) * max(neg)) END AS roc_auc FROM curve GROUP BY ALL),
ap AS (SELECT {_G}, sum(p * CAST(tp AS DOUBLE) / (tp + fp)) / nullif(max(pos), 0) AS average_precision FROM curve GROUP BY ALL),
two AS (SELECT window_id FROM nodes GROUP BY window_id HAVING min(is_fraud) <> max(is_fraud)),
threshold AS (SELECT {_G}, score AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY {_G} ORDER BY CAST(tp AS DOUBLE) / (tp + fp) DESC, score) AS r FROM curve WHERE pos > 0 AND CAST(tp AS DOUBLE) / pos >= 0.85) WHERE r = 1),
pred AS (SELECT window_id, algorithm, entity_id, is_fraud AS y_true, CAST(score >= threshold AS INT) AS y_pred FROM scores JOIN threshold USING (window_id, algorithm)),
conf AS (SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1
    FROM (SELECT {_G}, CAST(count(*) FILTER (y_true = 1 AND y_pred = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (y_true = 0 AND y_pred = 1) AS DOUBLE) AS fp, CAST(count(*) FILTER (y_true = 1 AND y_pred = 0) AS DOUBLE) AS fn, CAST(count(*) FILTER (y_true = 0 AND y_pred = 0) AS DOUBLE) AS tn FROM pred GROUP BY ALL))"""


def _at(ks: tuple[int, ...], clamp: bool = False) -> str:
    """Columns n, positives and found_k by group."""
    return f"SELECT {_G}, max(n) AS n, max(positives) AS positives, {', '.join(f'CAST(sum(is_fraud) FILTER (rank <= {k}) AS BIGINT) AS f{k}' for k in ks)} FROM ranked GROUP BY ALL"


def _wide(ks: tuple[int, ...]) -> str:
    cols = []
    for k in ks:
        ok = f"WHEN n >= {k} THEN"
        cols += [f"round(CASE {ok} f{k} / {k}.0 END, 6) AS precision_at_{k}", f"round(CASE {ok} coalesce(f{k} / nullif(CAST(positives AS DOUBLE), 0), 0) END, 6) AS recall_at_{k}", f"round(CASE WHEN n >= {k} AND positives > 0 THEN (f{k} / {k}.0) / (CAST(positives AS DOUBLE) / n) END, 6) AS lift_at_{k}", f"CASE {ok} f{k} END AS fraud_found_at_{k}"]
    return ", ".join(cols)


_DEG = "dout AS (SELECT window_id, source AS entity_id, count(*) AS out_n FROM edges GROUP BY ALL), din AS (SELECT window_id, target AS entity_id, count(*) AS in_n FROM edges GROUP BY ALL), deg AS (SELECT window_id, entity_id, coalesce(out_n, 0) AS out_n, coalesce(in_n, 0) AS in_n FROM dout FULL JOIN din USING (window_id, entity_id))"
_FAN_MOTIFS = f"{_DEG}, fans AS (SELECT window_id, entity_id, CAST(out_n BETWEEN 6 AND 16 AS BIGINT) AS fan_out_count, CAST(in_n BETWEEN 6 AND 16 AS BIGINT) AS fan_in_count FROM deg)"
_SCATTER = """sg AS (SELECT e1.window_id, e1.source AS u, e2.target AS v FROM edges AS e1 JOIN edges AS e2 ON e1.window_id = e2.window_id AND e1.target = e2.source
    JOIN dout AS du ON du.window_id = e1.window_id AND du.entity_id = e1.source JOIN din AS dv ON dv.window_id = e1.window_id AND dv.entity_id = e2.target JOIN dout AS dm ON dm.window_id = e1.window_id AND dm.entity_id = e1.target
    WHERE e1.source <> e2.target AND du.out_n BETWEEN 2 AND 16 AND dv.in_n BETWEEN 2 AND 16 GROUP BY ALL HAVING count(*) >= 2 AND count(*) FILTER (dm.out_n <= 16) >= 1),
scatter AS (SELECT window_id, entity_id, CAST(sum(s) AS BIGINT) AS scatter_gather_count, CAST(sum(g) AS BIGINT) AS gather_scatter_count FROM (SELECT window_id, u AS entity_id, 1 AS s, 0 AS g FROM sg UNION ALL SELECT window_id, v, 0, 1 FROM sg) GROUP BY ALL)"""
_CYCLES = """ok AS (SELECT window_id, entity_id FROM deg WHERE in_n > 0 AND out_n > 0 AND in_n + out_n <= 16),
ce AS (SELECT e.window_id, e.source AS s, e.target AS t FROM edges AS e JOIN ok AS a ON a.window_id = e.window_id AND a.entity_id = e.source JOIN ok AS b ON b.window_id = e.window_id AND b.entity_id = e.target),
cyc AS (SELECT window_id, [s] AS path FROM ce WHERE s = t
    UNION ALL SELECT a.window_id, [a.s, a.t] FROM ce AS a JOIN ce AS b ON a.window_id = b.window_id AND a.t = b.s AND b.t = a.s WHERE a.s < a.t
    UNION ALL SELECT a.window_id, [a.s, a.t, b.t] FROM ce AS a JOIN ce AS b ON a.window_id = b.window_id AND a.t = b.s JOIN ce AS c ON a.window_id = c.window_id AND b.t = c.s AND c.t = a.s WHERE a.s < a.t AND a.s < b.t AND a.t <> b.t),
cycles AS (SELECT window_id, entity_id, count(*) AS cycle_count FROM (SELECT window_id, unnest(path) AS entity_id FROM cyc) GROUP BY ALL)"""
_MOTIFS = f"{_DEG}, fans AS (SELECT window_id, entity_id, CAST(out_n BETWEEN 6 AND 16 AS BIGINT) AS fan_out_count, CAST(in_n BETWEEN 6 AND 16 AS BIGINT) AS fan_in_count FROM deg)"
_SCATTER = """sg AS (SELECT e1.window_id, e1.source AS u, e2.target AS v FROM edges AS e1 JOIN edges AS e2 ON e1.window_id = e2.window_id AND e1.target = e2.source
    JOIN dout AS du ON du.window_id = e1.window_id AND du.entity_id = e1.source JOIN din AS dv ON dv.window_id = e1.window_id AND dv.entity_id = e2.target JOIN dout AS dm ON dm.window_id = e1.window_id AND dm.entity_id = e1.target
    WHERE e1.source <> e2.target AND du.out_n BETWEEN 2 AND 16 AND dv.in_n BETWEEN 2 AND 16 GROUP BY ALL HAVING count(*) >= 2 AND count(*) FILTER (dm.out_n <= 16) >= 1),
scatter AS (SELECT window_id, entity_id, CAST(sum(s) AS BIGINT) AS scatter_gather_count, CAST(sum(g) AS BIGINT) AS gather_scatter_count FROM (SELECT window_id, u AS entity_id, 1 AS s, 0 AS g FROM sg UNION ALL SELECT window_id, v, 0, 1 FROM sg) GROUP BY ALL)"""
_CYCLES = """ok AS (SELECT window_id, entity_id FROM deg WHERE in_n > 0 AND out_n > 0 AND in_n + out_n <= 16),
ce AS (SELECT e.window_id, e.source AS s, e.target AS t FROM edges AS e JOIN ok AS a ON a.window_id = e.window_id AND a.entity_id = e.source JOIN ok AS b ON b.window_id = e.window_id AND b.entity_id = e.target),
cyc AS (SELECT window_id, [s] AS path FROM ce WHERE s = t
    UNION ALL SELECT a.window_id, [a.s, a.t] FROM ce AS a JOIN ce AS b ON a.window_id = b.window_id AND a.t = b.s AND b.t = a.s WHERE a.s < a.t
    UNION ALL SELECT a.window_id, [a.s, a.t, b.t] FROM ce AS a JOIN ce AS b ON a.window_id = b.window_id AND a.t = b.s JOIN ce AS c ON a.window_id = c.window_id AND b.t = c.s AND c.t = a.s WHERE a.s < a.t AND a.s < b.t AND a.t <> b.t),
cycles AS (SELECT window_id, entity_id, count(*) AS cycle_count FROM (SELECT window_id, unnest(path) AS entity_id FROM cyc) GROUP BY ALL)"""
_CYCLES_ANY = """ok AS (SELECT window_id, entity_id FROM deg WHERE in_n > 0 AND out_n > 0 AND in_n + out_n <= 16),
ce AS (SELECT e.window_id, e.source AS s, e.target AS t FROM edges AS e JOIN ok AS a ON a.window_id = e.window_id AND a.entity_id = e.source JOIN ok AS b ON b.window_id = e.window_id AND b.entity_id = e.target),
walk AS (SELECT window_id, [s] AS path, t AS last FROM ce WHERE s <= t UNION ALL SELECT w.window_id, list_append(path, last), ce.t FROM walk AS w JOIN ce ON w.window_id = ce.window_id AND w.last = ce.s WHERE w.last <> path[1] AND ce.t >= path[1] AND len(path) < 6 AND NOT (ce.t <> path[1] AND (list_contains(path, ce.t) OR ce.t = w.last))),
cycles AS (SELECT window_id, entity_id, count(*) AS cycle_count FROM (SELECT window_id, unnest(path) AS entity_id FROM walk WHERE last = path[1]) GROUP BY ALL)"""
_MOTIFS = f"{_EDGES}, {_FRAUD}, {_FAN_MOTIFS}, {_SCATTER}, {_CYCLES}, m AS (SELECT window_id, entity_id, is_fraud, coalesce(fan_out_count, 0) AS fan_out_count, coalesce(fan_in_count, 0) AS fan_in_count, coalesce(scatter_gather_count, 0) AS scatter_gather_count, coalesce(gather_scatter_count, 0) AS gather_scatter_count, coalesce(cycle_count, 0) AS cycle_count FROM fraud LEFT JOIN fans USING (window_id, entity_id) LEFT JOIN scatter USING (window_id, entity_id) LEFT JOIN cycles USING (window_id, entity_id))"
_PAIRS = "tops AS (SELECT window_id, max(volume) AS top FROM edges GROUP BY ALL), pairs AS (SELECT window_id, least(source, target) AS a, greatest(source, target) AS b, sum(cbrt(volume / top)) AS g, count(*) AS ways FROM edges JOIN tops USING (window_id) WHERE source <> target GROUP BY ALL), tri AS (SELECT x.window_id, x.a AS x, x.b AS y, y.b AS z, x.g * y.g * z.g AS p FROM pairs AS x JOIN pairs AS y ON x.window_id = y.window_id AND x.b = y.a JOIN pairs AS z ON x.window_id = z.window_id AND x.a = z.a AND y.b = z.b)"
_UND = "und AS (SELECT DISTINCT window_id, a, b FROM (SELECT window_id, source AS a, target AS b FROM edges WHERE source <> target UNION ALL SELECT window_id, target, source FROM edges WHERE source <> target)), ids AS (SELECT DISTINCT window_id, entity_id FROM (SELECT window_id, source AS entity_id FROM edges UNION ALL SELECT window_id, target FROM edges))"
_REACH = f"{_UND}, reach AS (SELECT window_id, entity_id AS v, entity_id AS u FROM ids UNION SELECT r.window_id, r.v, und.b FROM reach AS r JOIN und ON r.window_id = und.window_id AND r.u = und.a), comp AS (SELECT window_id, v AS entity_id, min(u) AS component_id FROM reach GROUP BY ALL)"
_COMMUNITIES = f"{_EDGES}, {_FRAUD}, {_REACH}, stats AS (SELECT window_id, component_id AS community, count(*) AS size, CAST(sum(is_fraud) AS BIGINT) AS fraud_count, avg(is_fraud) AS fraud_rate FROM comp JOIN fraud USING (window_id, entity_id) GROUP BY ALL), sw AS (SELECT *, sum(size) OVER (PARTITION BY window_id) AS wn, sum(fraud_count) OVER (PARTITION BY window_id) AS wf FROM stats)"


def _settled(table: str, value: str, bound: str) -> str:
    """it: the first round, from the twentieth on, that changes a window's values by less than the bound in sum."""
    return f"""settled AS (SELECT window_id, min(it) AS it FROM (SELECT window_id, it, sum(abs({value} - was)) AS moved FROM (SELECT *, lag({value}) OVER (PARTITION BY window_id, entity_id ORDER BY it) AS was FROM {table}) WHERE it >= 20 GROUP BY ALL) JOIN sizes USING (window_id) WHERE moved < {bound} GROUP BY window_id)"""


def _pagerank(alpha: float, weight: str, name: str, rounds: int = 100) -> str:
    return f"""WITH RECURSIVE {_EDGES}, {_UND}, sizes AS (SELECT window_id, count(*) AS n FROM ids GROUP BY ALL),
    outs AS (SELECT window_id, source, sum({weight}) AS o FROM edges GROUP BY ALL),
    shares AS (SELECT e.window_id, e.source, e.target, {weight} / CAST(o AS DOUBLE) AS share FROM edges AS e JOIN outs USING (window_id, source) UNION ALL SELECT window_id, entity_id, entity_id, 0 FROM ids),
    pr AS (SELECT 0 AS it, window_id, entity_id, 1.0e0 / n AS r FROM ids JOIN sizes USING (window_id)
        UNION ALL SELECT it + 1, f.window_id, f.entity_id, {alpha} * (flow + (1 - sum(flow) OVER (PARTITION BY f.window_id)) / n) + (1 - {alpha}) / n
        FROM (SELECT it, s.window_id, s.target AS entity_id, sum(r * share) AS flow FROM pr JOIN shares AS s ON pr.window_id = s.window_id AND pr.entity_id = s.source WHERE it < {rounds} GROUP BY ALL) AS f JOIN sizes ON sizes.window_id = f.window_id),
    {_settled('pr', 'r', '1e-6 * n')}
    SELECT window_id, entity_id, round(r, 8) AS {name} FROM pr JOIN settled USING (window_id, it)"""


def _betweenness(levels: int = 8, pivots: int = 80) -> str:
    """Shortest paths from the pivots level by level, then what each entity passes back; windows compared are less deep than ``levels``."""
    on = lambda a, b: f"{a}.window_id = {b}.window_id AND {a}.p = {b}.p"
    steps = ["l0 AS MATERIALIZED (SELECT window_id, p, p AS v, 1.0e0 AS paths FROM pivots)", "s0 AS MATERIALIZED (SELECT window_id, p, v FROM l0)"]
    for k in range(1, levels + 1):
        steps.append(f"l{k} AS MATERIALIZED (SELECT * FROM (SELECT l.window_id, l.p, e.t AS v, sum(paths) AS paths FROM l{k - 1} AS l JOIN e ON l.window_id = e.window_id AND l.v = e.s GROUP BY ALL) ANTI JOIN s{k - 1} USING (window_id, p, v))")
        steps.append(f"s{k} AS MATERIALIZED (FROM s{k - 1} UNION ALL SELECT window_id, p, v FROM l{k})")
    steps.append(f"g{levels} AS MATERIALIZED (SELECT *, 0.0e0 AS gain FROM l{levels})")
    for k in range(levels - 1, 0, -1):
        steps.append(f"g{k} AS MATERIALIZED (SELECT l.*, coalesce(x.gain, 0) AS gain FROM l{k} AS l LEFT JOIN (SELECT b.window_id, b.p, b.v, sum(b.paths / g.paths * (1 + g.gain)) AS gain FROM g{k + 1} AS g JOIN e ON g.window_id = e.window_id AND g.v = e.t JOIN l{k} AS b ON {on('b', 'g')} AND b.v = e.s GROUP BY ALL) AS x USING (window_id, p, v))")
    every = " UNION ALL ".join(f"SELECT window_id, v, gain FROM g{k}" for k in range(1, levels + 1))
    return f"""WITH {_EDGES}, {_UND}, e AS MATERIALIZED (SELECT window_id, source AS s, target AS t FROM edges WHERE source <> target), sizes AS (SELECT window_id, count(*) AS n FROM ids GROUP BY ALL),
    pivots AS (SELECT window_id, entity_id AS p FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY md5(window_id || ':' || entity_id || ':42')) AS nth FROM ids) WHERE nth <= {pivots}),
    {', '.join(steps)}, total AS (SELECT window_id, v AS entity_id, sum(gain) AS gain FROM ({every}) GROUP BY ALL)
    SELECT window_id, entity_id, round(coalesce(gain, 0) * CASE WHEN n > 2 THEN n / least(n, {pivots}) / ((n - 1) * (n - 2)) ELSE 0 END, 8) AS betweenness FROM ids JOIN sizes USING (window_id) LEFT JOIN total USING (window_id, entity_id)"""


#: Rounds after which HITS in SQL gives up; the windows compared need fewer.
HITS_ROUNDS = 80
_BANDS = "CASE WHEN size >= 500 THEN '500+' WHEN size >= 100 THEN '100-499' WHEN size >= 50 THEN '50-99' WHEN size >= 10 THEN '10-49' WHEN size >= 5 THEN '5-9' WHEN size >= 2 THEN '2-4' ELSE '1' END"
_ENDS = "ends AS (SELECT from_account AS account_number, is_laundering FROM ledger UNION ALL SELECT to_account, is_laundering FROM ledger)"
_STATUS = f"{_BASE}, {_ENDS}, status AS (SELECT entity_id, min(entity_name) AS entity_name, count(*) AS total_txns, CAST(sum(is_laundering) AS BIGINT) AS fraud_txns, max(is_laundering) AS is_fraudulent, round(100.0 * sum(is_laundering) / count(*), 2) AS fraud_txn_pct FROM ends JOIN accounts USING (account_number) GROUP BY entity_id)"
_MOTIF_NAMES = ("fan_out_count", "fan_in_count", "scatter_gather_count", "gather_scatter_count", "cycle_count")
_DAY = "strftime(window_start, '%Y-%m-%d') AS window_start, strftime(window_end, '%Y-%m-%d') AS window_end"
_STATS4 = lambda c: f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std, round(min({c}), 6) AS {c}_min, round(max({c}), 6) AS {c}_max"
_WINDOW_METRICS = f"""wm AS (SELECT window_id, algorithm, accuracy, precision, recall, f1 AS f1_score, roc_auc, average_precision AS auprc, {', '.join(f'f{k} / CAST(least({k}, n) AS DOUBLE) AS P_at_{k}' for k in (100, 200, 300, 500))}
    FROM conf JOIN auc USING (window_id, algorithm) JOIN ap USING (window_id, algorithm) JOIN ({_at((100, 200, 300, 500))}) USING (window_id, algorithm) WHERE window_id IN (SELECT window_id FROM two))"""
_ABL = f"{_SCORES}, {_WINDOW_METRICS}, abl AS (SELECT b.window_id, {', '.join(f'b.{m} AS base_{m}, f.{m} AS full_{m}, f.{m} - b.{m} AS delta_{m}, (f.{m} - b.{m}) / (b.{m} + 1e-9) * 100 AS lift_{m}' for m in ABLATION)} FROM wm AS b JOIN wm AS f ON b.window_id = f.window_id WHERE b.algorithm = 'vol_sent' AND f.algorithm = 'degree')"
#: One minus Simpson's rule over Student's density from -t to t.
_P_VALUE = "1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * abs(t) / 2000 / 3 * list_sum(list_transform(range(2001), lambda k: (CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow(t * k / 2000, 2) / df, -(df + 1) / 2)))"
_HEUR = f"{_SCORES}, heur AS (SELECT window_id, algorithm AS feature, average_precision AS auprc, roc_auc, {', '.join(f'f{k} / CAST(least({k}, n) AS DOUBLE) AS p_at_{k}' for k in (10, 50, 100, 500))} FROM ({_at((10, 50, 100, 500))}) JOIN ap USING (window_id, algorithm) JOIN auc USING (window_id, algorithm) WHERE window_id IN (SELECT window_id FROM two))"

ORACLES: dict[str, str] = {
    "cutoff_filter": f"WITH {_BASE} SELECT tx_id, from_account, to_account, amount_sent_c FROM ledger WHERE timestamp <= TIMESTAMP '{CUTOFF} 00:00:00'",
    "fx_fill": f"WITH {_BASE} SELECT strftime(date, '%Y-%m-%d') AS date, currency, round(rate, 6) AS rate FROM fx",
    "fx_convert": f"WITH {_BASE} SELECT tx_id, payment_currency, round(adj_sent, 6) AS adj_sent FROM converted",
    "resolve_entities": f"WITH {_BASE} SELECT tx_id, source, target, round(adj_sent, 6) AS adj_sent, is_laundering, payment_format FROM resolved",
    "window_calendar": f"WITH {_BASE}, {_calendar()} SELECT window_id, {_DAY} FROM cal",
    "tumbling_calendar": f"WITH {_BASE}, {_calendar(7, 7)} SELECT window_id, {_DAY} FROM cal",
    "window_edges": f"WITH {_EDGES} SELECT window_id, {_DAY}, source, target, round(volume, 6) AS volume, count, round(time_variance, 3) AS time_variance FROM edges",
    "node_sent": f"WITH {_WINDOWS}, {_SENT} SELECT * REPLACE (round(vol_sent, 6) AS vol_sent, round(time_variance, 3) AS time_variance) FROM sent",
    "node_recv": f"WITH {_WINDOWS}, {_RECV} SELECT * REPLACE (round(vol_recv, 6) AS vol_recv) FROM recv",
    "entity_fraud": f"WITH {_WINDOWS}, {_FRAUD} SELECT * FROM fraud",
    "temporal_fan": f"WITH {_WINDOWS}, {_FANS} SELECT window_id, entity_id, coalesce(temporal_fan_out_count, 0) AS temporal_fan_out_count, coalesce(temporal_fan_in_count, 0) AS temporal_fan_in_count FROM temporal_fan_out_count FULL JOIN temporal_fan_in_count USING (window_id, entity_id)",
    "node_profile": f"WITH {_NODES} SELECT * FROM nodes",
    "flow_ratio": f"WITH {_WINDOWS}, {_SENT}, {_RECV} SELECT window_id, entity_id, round(coalesce(coalesce(vol_sent, 0) / nullif(CASE WHEN vol_recv > 0 THEN vol_recv ELSE coalesce(vol_sent, 0) END, 0), 0), 6) AS flow_ratio FROM sent FULL JOIN recv USING (window_id, entity_id)",
    "tx_fraud_rate": f"WITH {_BASE} SELECT count(*) AS total_transactions, CAST(sum(is_laundering) AS BIGINT) AS fraudulent_transactions, round(100.0 * sum(is_laundering) / count(*), 4) AS fraud_rate_pct FROM ledger",
    "account_fraud_rate": f"WITH {_BASE}, {_ENDS} SELECT count(*) AS total_accounts, CAST(sum(bad) AS BIGINT) AS fraudulent_accounts, round(100.0 * sum(bad) / count(*), 4) AS fraud_rate_pct FROM (SELECT account_number, max(is_laundering) AS bad FROM ends GROUP BY ALL)",
    "entity_fraud_rate": f"WITH {_STATUS} SELECT count(*) AS total_entities, CAST(sum(is_fraudulent) AS BIGINT) AS fraudulent_entities, round(100.0 * sum(is_fraudulent) / count(*), 4) AS fraud_rate_pct FROM status",
    "fraud_entities": f"WITH {_STATUS} SELECT * FROM status WHERE is_fraudulent = 1",
    "fan_motifs": f"WITH {_EDGES}, {_FAN_MOTIFS} SELECT * FROM fans",
    "scatter_gather": f"WITH {_EDGES}, {_DEG}, {_SCATTER} SELECT * FROM scatter",
    "cycles_le3": f"WITH {_EDGES}, {_DEG}, {_CYCLES} SELECT * FROM cycles",
    "egonet": f"WITH {_EDGES}, {_UND}, mem AS (SELECT window_id, entity_id AS ego, entity_id AS m FROM ids UNION SELECT window_id, source, target FROM edges), inner_e AS (SELECT a.window_id, a.ego, volume FROM mem AS a JOIN edges AS e ON a.window_id = e.window_id AND a.m = e.source JOIN mem AS b ON b.window_id = a.window_id AND b.ego = a.ego AND b.m = e.target), cn AS (SELECT window_id, ego, count(*) AS n FROM mem GROUP BY ALL), cm AS (SELECT window_id, ego, count(*) AS m, sum(volume) AS v FROM inner_e GROUP BY ALL) SELECT window_id, ego AS entity_id, n AS egonet_node_count, coalesce(m, 0) AS egonet_edge_count, round(CASE WHEN n > 1 THEN coalesce(m, 0) / CAST(n * (n - 1) AS DOUBLE) ELSE 0 END, 6) AS egonet_density, round(coalesce(v, 0), 6) AS egonet_total_weight FROM cn LEFT JOIN cm USING (window_id, ego)",
    "clustering": f"WITH {_EDGES}, {_PAIRS}, t AS (SELECT window_id, unnest([x, y, z]) AS entity_id, p FROM tri), tp AS (SELECT window_id, entity_id, sum(p) AS p FROM t GROUP BY ALL), d AS (SELECT window_id, entity_id, sum(ways) AS total, count(*) FILTER (ways = 2) AS mutual FROM (SELECT window_id, unnest([a, b]) AS entity_id, ways FROM pairs) GROUP BY ALL) SELECT window_id, entity_id, round(coalesce(p / nullif(total * (total - 1) - 2 * mutual, 0), 0), 6) AS local_clustering_coefficient FROM d JOIN tp USING (window_id, entity_id)",
    "triangles": f"WITH {_EDGES}, {_PAIRS} SELECT window_id, entity_id, count(*) AS triangle_count FROM (SELECT window_id, unnest([x, y, z]) AS entity_id FROM tri) GROUP BY ALL",
    "avg_nbr_degree": f"WITH {_EDGES}, {_DEG} SELECT e.window_id, e.source AS entity_id, round(avg(coalesce(out_n, 0)), 6) AS average_neighbor_degree FROM edges AS e LEFT JOIN dout ON dout.window_id = e.window_id AND dout.entity_id = e.target GROUP BY ALL",
    "successor_volume": f"WITH {_EDGES} SELECT window_id, source AS entity_id, round(avg(volume), 9) AS successor_avg_volume, round(max(volume), 6) AS successor_max_volume FROM edges GROUP BY ALL",
    "pagerank_volume": _pagerank(0.85, "volume", "pr_vol_deep"),
    "pagerank_shallow": _pagerank(0.75, "volume", "pr_vol_shallow"),
    "pagerank_count": _pagerank(0.85, "count", "pr_count"),
    "hits": f"""WITH RECURSIVE {_EDGES}, {_UND}, sizes AS (SELECT window_id, count(*) AS n FROM ids GROUP BY ALL), cc AS MATERIALIZED (SELECT a.window_id, a.source AS x, b.source AS y, count(*) AS n FROM edges AS a JOIN edges AS b ON a.window_id = b.window_id AND a.target = b.target GROUP BY ALL),
        hub AS (SELECT 0 AS it, window_id, entity_id, 1.0e0 AS h FROM ids UNION ALL SELECT it + 1, window_id, entity_id, h / sum(h) OVER (PARTITION BY window_id) FROM (SELECT it, cc.window_id, cc.y AS entity_id, sum(h * n) AS h FROM hub JOIN cc ON hub.window_id = cc.window_id AND hub.entity_id = cc.x WHERE it < {HITS_ROUNDS} GROUP BY ALL)),
        {_settled('hub', 'h', '1e-8')},
        auth AS (SELECT window_id, entity_id, a / sum(a) OVER (PARTITION BY window_id) AS a FROM (SELECT e.window_id, target AS entity_id, sum(h) AS a FROM hub JOIN settled ON settled.window_id = hub.window_id AND hub.it = settled.it - 1 JOIN edges AS e ON hub.window_id = e.window_id AND hub.entity_id = e.source GROUP BY ALL))
        SELECT window_id, entity_id, round(coalesce(h, 0), 8) AS hits_hub, round(coalesce(a, 0), 8) AS hits_auth FROM ids LEFT JOIN (SELECT * FROM hub JOIN settled USING (window_id, it)) USING (window_id, entity_id) LEFT JOIN auth USING (window_id, entity_id)""",
    "betweenness": _betweenness(),
    "k_core": f"""WITH RECURSIVE {_EDGES}, {_UND}, k AS (SELECT 0 AS it, window_id, a AS v, count(*) AS k FROM und GROUP BY ALL
        UNION ALL SELECT it + 1, window_id, v, max(least(k, rn)) FROM (SELECT it, und.window_id, und.a AS v, k, row_number() OVER (PARTITION BY und.window_id, und.a ORDER BY k DESC) AS rn FROM k JOIN und ON k.window_id = und.window_id AND k.v = und.b WHERE it < 60) GROUP BY ALL)
        SELECT window_id, entity_id, coalesce(k, 0) AS k_core FROM ids LEFT JOIN (SELECT window_id, v AS entity_id, k FROM k WHERE it = 60) USING (window_id, entity_id)""",
    "components": f"WITH RECURSIVE {_EDGES}, {_REACH} SELECT * FROM comp",
    "modularity": f"WITH {_EDGES}, p AS (SELECT DISTINCT window_id, least(source, target) AS a, greatest(source, target) AS b FROM edges WHERE source <> target), m AS (SELECT window_id, count(*) AS m, count(*) FILTER (a % 5 = b % 5) AS i FROM p GROUP BY ALL), k AS (SELECT window_id, sum(k * k) AS k2 FROM (SELECT window_id, l, CAST(count(*) AS DOUBLE) AS k FROM (SELECT window_id, unnest([a % 5, b % 5]) AS l FROM p) GROUP BY ALL) GROUP BY ALL) SELECT window_id, round(i / CAST(m AS DOUBLE) - k2 / (4.0e0 * m * m), 8) AS modularity FROM m JOIN k USING (window_id)",
    "precision_at_k": f"WITH {_SCORES}, a AS ({_at((1, 2, 10, 50, 100, 500))}), l AS ({' UNION ALL '.join(f'SELECT {_G}, n, positives, CAST({k} AS BIGINT) AS k, f{k} AS fraud_found FROM a WHERE n >= {k}' for k in (1, 2, 10, 50, 100, 500))}) SELECT {_G}, k, fraud_found, round(fraud_found / CAST(k AS DOUBLE), 6) AS precision, round(coalesce(fraud_found / nullif(CAST(positives AS DOUBLE), 0), 0), 6) AS recall, round(CASE WHEN positives > 0 THEN (fraud_found / CAST(k AS DOUBLE)) / (CAST(positives AS DOUBLE) / n) END, 6) AS lift FROM l",
    "roc_auc": f"WITH {_SCORES} SELECT {_G}, round(roc_auc, 6) AS roc_auc FROM auc",
    "average_precision": f"WITH {_SCORES} SELECT {_G}, round(average_precision, 6) AS average_precision FROM ap",
    "ranking_metrics": f"WITH {_SCORES} SELECT {_G}, n AS total_nodes, CAST(positives AS BIGINT) AS total_fraud, round(CAST(positives AS DOUBLE) / n, 6) AS fraud_rate, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision, {_wide((1, 2, 10, 50, 100, 500))} FROM ({_at((1, 2, 10, 50, 100, 500))}) JOIN auc USING (window_id, algorithm) JOIN ap USING (window_id, algorithm)",
    "metric_summary": f"WITH {_SCORES}, w AS (SELECT algorithm, roc_auc, average_precision, CASE WHEN n >= 10 THEN f10 / 10.0 END AS precision_at_10, CASE WHEN n >= 10 AND positives > 0 THEN (f10 / 10.0) / (CAST(positives AS DOUBLE) / n) END AS lift_at_10 FROM ({_at((10,))}) JOIN auc USING (window_id, algorithm) JOIN ap USING (window_id, algorithm)) SELECT algorithm, count(*) AS windows, {', '.join(f'round(avg({c}), 6) AS mean_{c}, round(median({c}), 6) AS median_{c}' for c in ('roc_auc', 'average_precision', 'precision_at_10', 'lift_at_10'))} FROM w GROUP BY algorithm",
    "heuristic_metrics": f"WITH {_HEUR} SELECT window_id, feature, round(auprc, 6) AS auprc, round(roc_auc, 6) AS roc_auc, {', '.join(f'round(p_at_{k}, 6) AS p_at_{k}' for k in (10, 50, 100, 500))} FROM heur",
    "heuristic_stats": f"WITH {_HEUR} SELECT feature, {_STATS4('auprc')}, {_STATS4('roc_auc')} FROM heur GROUP BY feature",
    "calibrate_threshold": f"WITH {_SCORES} SELECT * FROM threshold",
    "confusion_metrics": f"WITH {_SCORES} SELECT {_G}, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM conf",
    "pooled_summary": f"WITH {_SCORES} SELECT algorithm, count(*) AS windows, round(sum(tp + tn) / sum(tp + fp + fn + tn), 6) AS pooled_accuracy, round(coalesce(sum(tp) / nullif(sum(tp + fp), 0), 0), 6) AS pooled_precision, round(coalesce(sum(tp) / nullif(sum(tp + fn), 0), 0), 6) AS pooled_recall, round(coalesce(2 * sum(tp) / nullif(sum(2 * tp + fp + fn), 0), 0), 6) AS pooled_f1, {', '.join(f'round(avg({m}), 6) AS mean_{m}, round(stddev_samp({m}), 6) AS std_{m}' for m in ('accuracy', 'precision', 'recall', 'f1'))} FROM conf GROUP BY algorithm",
    "heuristic_pivot": f"WITH {_HEUR} SELECT window_id, {', '.join(f"round(any_value(auprc) FILTER (feature = '{c}'), 6) AS {c}" for c in SCORES)} FROM heur GROUP BY window_id",
    "entity_recall": f"WITH {_SCORES} SELECT algorithm, fraud_entities, found_entities, round(coalesce(found_entities / nullif(CAST(fraud_entities AS DOUBLE), 0), 0), 6) AS entity_recall FROM (SELECT algorithm, count(DISTINCT entity_id) FILTER (y_true = 1) AS fraud_entities, count(DISTINCT entity_id) FILTER (y_true = 1 AND y_pred = 1) AS found_entities FROM pred GROUP BY algorithm)",
    "fwd_chain_split": f"WITH {_NODES}, c AS (SELECT window_id, count(*) AS test_rows, CAST(sum(is_fraud) AS BIGINT) AS test_fraud FROM nodes GROUP BY ALL) SELECT * FROM (SELECT window_id, test_rows, test_fraud, CAST(sum(test_rows) OVER w AS BIGINT) AS train_rows, CAST(sum(test_fraud) OVER w AS BIGINT) AS train_fraud FROM c WINDOW w AS (ORDER BY window_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE window_id >= 2",
    "ablation_delta": f"WITH {_ABL} SELECT window_id, {', '.join(f'round({p}_{m}, {2 if p == "lift" else 5}) AS {p}_{m}' for m in ABLATION for p in ('base', 'full', 'delta', 'lift'))} FROM abl",
    "ablation_tests": f"WITH {_ABL}, l AS ({' UNION ALL '.join(f"""SELECT '{m}' AS measure, base_{m} AS b, full_{m} AS f FROM abl""" for m in ABLATION)}), t AS (SELECT measure, avg(f - b) AS mean_delta, stddev_samp(f - b) AS std_delta, avg(b - f) / nullif(stddev_samp(b - f) / sqrt(count(*)), 0) AS t, CAST(count(*) - 1 AS DOUBLE) AS df FROM l GROUP BY measure), p AS (SELECT *, CASE WHEN t IS NOT NULL THEN {_P_VALUE} END AS p FROM t) SELECT measure, round(mean_delta, 6) AS mean_delta, round(std_delta, 6) AS std_delta, round(t, 5) AS t_statistic, df, round(p, 5) AS p_value, coalesce(p < 0.05, false) AS significant FROM p",
    "community_stats": f"WITH RECURSIVE {_COMMUNITIES} SELECT window_id, community, size, fraud_count, round(fraud_rate, 6) AS fraud_rate FROM stats",
    "community_size_bands": f"WITH RECURSIVE {_COMMUNITIES} SELECT window_id, band, communities, nodes, fraud, round(fraud / CAST(nodes AS DOUBLE), 6) AS fraud_rate, round(coalesce((fraud / CAST(nodes AS DOUBLE)) / nullif(wf / CAST(wn AS DOUBLE), 0), 0), 6) AS lift FROM (SELECT window_id, {_BANDS} AS band, count(*) AS communities, CAST(sum(size) AS BIGINT) AS nodes, CAST(sum(fraud_count) AS BIGINT) AS fraud, max(wf) AS wf, max(wn) AS wn FROM sw GROUP BY ALL)",
    "fraud_rings": f"WITH RECURSIVE {_COMMUNITIES}, h AS (SELECT *, fraud_rate > 2 * wf / CAST(wn AS DOUBLE) AS high, fraud_rate = 1 AND size >= 2 AS ring FROM sw) SELECT window_id, count(*) AS communities, count(*) FILTER (fraud_count > 0) AS with_fraud, round(avg(fraud_rate) FILTER (fraud_count > 0), 6) AS mean_rate_with_fraud, count(*) FILTER (ring) AS rings, CAST(coalesce(sum(size) FILTER (ring), 0) AS BIGINT) AS ring_nodes, count(*) FILTER (high) AS high_risk, CAST(coalesce(sum(fraud_count) FILTER (high), 0) AS BIGINT) AS high_risk_fraud, CAST(max(wf) AS BIGINT) AS total_fraud, round(coalesce(coalesce(sum(fraud_count) FILTER (high), 0) / nullif(CAST(max(wf) AS DOUBLE), 0), 0), 6) AS high_risk_share FROM h GROUP BY window_id",
    "component_top": f"WITH RECURSIVE {_COMMUNITIES} SELECT window_id, rank, community, size, fraud_count, round(fraud_rate, 6) AS fraud_rate, round(coalesce(fraud_rate / nullif(wf / CAST(wn AS DOUBLE), 0), 0), 6) AS lift FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY fraud_rate DESC, size DESC, community) AS rank FROM sw WHERE size >= 3) WHERE rank <= 10",
    "component_concentration": f"WITH RECURSIVE {_COMMUNITIES} SELECT window_id, CAST(sum(size) AS BIGINT) AS nodes, CAST(sum(fraud_count) AS BIGINT) AS fraud, count(*) AS communities, count(*) FILTER (fraud_count > 0) AS with_fraud, count(*) FILTER (fraud_rate = 1) AS fraud_only, round(avg(fraud_rate) FILTER (fraud_count > 0), 6) AS mean_rate_with_fraud, round(avg(size), 6) AS mean_size, round(stddev_samp(size), 6) AS std_size, min(size) AS least_size, max(size) AS most_size, round(sum(fraud_count) / CAST(sum(size) AS DOUBLE), 6) AS fraud_rate, round(count(*) FILTER (fraud_count > 0) / CAST(count(*) AS DOUBLE), 6) AS with_fraud_share, round(100.0e0 * count(*) / CAST(sum(size) AS DOUBLE), 6) AS communities_pct FROM stats GROUP BY window_id",
    "motif_prevalence": f"WITH {_MOTIFS}, l AS ({' UNION ALL '.join(f'''SELECT '{m}' AS motif, is_fraud, {m} AS n FROM m''' for m in _MOTIF_NAMES)}), a AS (SELECT motif, count(*) AS total_entities, count(*) FILTER (n > 0) AS entities_with_motif, CAST(sum(n) AS BIGINT) AS instances, avg(n) AS mean_per_entity, coalesce(avg(n) FILTER (is_fraud = 1), 0) AS fraud_mean, coalesce(avg(n) FILTER (is_fraud = 0), 0) AS other_mean FROM l GROUP BY motif) SELECT motif, total_entities, entities_with_motif, instances, round(mean_per_entity, 6) AS mean_per_entity, round(fraud_mean, 6) AS fraud_mean, round(other_mean, 6) AS other_mean, round(CASE WHEN other_mean > 0 THEN fraud_mean / other_mean END, 6) AS ratio FROM a",
    "topk_motif": f"WITH {_MOTIFS} SELECT window_id, entity_id, CAST({' + '.join(_MOTIF_NAMES)} AS BIGINT) AS total_motif_count, {', '.join(_MOTIF_NAMES)}, is_fraud FROM m ORDER BY total_motif_count DESC, window_id, entity_id LIMIT 10",
    "cycle_lift": f"WITH {_MOTIFS} SELECT count(*) FILTER (cycle_count > 0) AS entities_with_cycles, round(avg(is_fraud) FILTER (cycle_count > 0), 6) AS cycle_fraud_rate, round(avg(is_fraud) FILTER (cycle_count > 0) / nullif(avg(is_fraud), 0), 6) AS cycle_lift FROM m",
    # twenty others for each flagged row are all there are, as more than a twenty-first of the rows is flagged
    "undersample": f"WITH {_NODES} SELECT window_id, entity_id, is_fraud FROM nodes",
    "spearman_pairs": f"WITH {_NODES}, ranks AS MATERIALIZED (SELECT {', '.join(f'rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0e0 AS {c}' for c in MODEL_COLUMNS)} FROM nodes), rho AS ({' UNION ALL '.join(f"""SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS rho FROM ranks""" for i, a in enumerate(MODEL_COLUMNS) for b in MODEL_COLUMNS[i + 1 :])}) SELECT a, b, round(coalesce(CASE WHEN isfinite(rho) THEN rho END, 0), 6) AS rho FROM rho",
}
