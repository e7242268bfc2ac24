"""DuckDB SQL for the registered queries, over the same tables.

The common tables mirror the plans in other words: self-joins for payoffs,
ASOF JOIN for spot, frames that look forward for peaks.
"""

from __future__ import annotations


def r(x: str, n: int) -> str:
    return f"floor(({x}) * 1e{n} + 0.5) / 1e{n}"


def candles(source: str, slot: str, keys: str, order: str = "ts, seq") -> str:
    return (
        f"SELECT {keys}, {slot} AS ts, first(price ORDER BY {order}) AS open, max(price) AS high, min(price) AS low, "
        f"last(price ORDER BY {order}) AS close, sum(qty) AS volume FROM {source} GROUP BY {keys}, {slot}"
    )


def slot(minutes: int, t: str = "t") -> str:
    """Slots of durations that divide a day count from 12:00 UTC."""
    s = minutes * 60
    return f"(floor(({t} - 43200) / {s}.0)::BIGINT * {s} + 43200)"


HALF = "(CASE WHEN typ = 'C' THEN 1.0 ELSE -1.0 END)"
OTM = "coalesce(CASE WHEN typ = 'C' THEN strike > sp ELSE strike < sp END, false)"
DISTANCE = f"coalesce({r(f'CASE WHEN sp > 0 THEN {HALF} * (strike - sp) / sp * 100 END', 3)}, 0.0)"
AVERAGE = "((lows + low + close) / (len + 2.0))"
STATE = "CASE WHEN pk IS NULL THEN 'pending' WHEN pk > high THEN 'activated' ELSE 'slHit' END"
RATIO = f"CASE WHEN pk IS NULL OR high <= 0 THEN 0.0 ELSE {r('pk / high', 3)} END"
SETTLE = "(epoch(expiry)::BIGINT)"
W = "(PARTITION BY symbol, expiry ORDER BY ts)"


def asof(table: str, at: str, alias: str = "sp") -> str:
    return f"(SELECT x.*, s.close AS {alias} FROM {table} x ASOF LEFT JOIN spot s ON x.{at} >= s.ts)"


def typed(c: str) -> str:
    return f"split_part({c}, '-', 1) AS typ, try_cast(split_part({c}, '-', 3) AS DOUBLE) AS strike"


def lags(n: int) -> str:
    up, down = "greatest(open, close)", "least(open, close)"
    return " + ".join(f"(abs({up} - lag({up}, {k}) OVER {W}) + abs({down} - lag({down}, {k}) OVER {W}))" for k in range(1, n + 1))


SIGNAL_COLUMNS = "symbol, expiry, typ, strike, ts, start, value, close, high, low, open, pk, pkn, n, dist_pct, avg_price, sp0"
TABLES = {
    "ticks": "SELECT event_type AS symbol, ts, floor(epoch(ts))::BIGINT AS t, value AS price, 1.0::DOUBLE AS qty, event_id AS seq FROM events",
    "ct": (
        "SELECT (CASE WHEN user_id % 20 % 2 = 0 THEN 'C' ELSE 'P' END) || '-EVT-' || (5 + 3 * (user_id % 20 // 2)) || '-' || (user_id % 20) AS symbol, "
        "DATE '2024-01-01' + (3 * (floor((floor(epoch(ts)) - 1704067200) / 259200)::INTEGER + 1)) AS expiry, ts, floor(epoch(ts))::BIGINT AS t, value AS price, 1.0::DOUBLE AS qty, event_id AS seq FROM events"
    ),
    "c0": candles("ct", slot(120), "symbol, expiry"),
    "c1": f"SELECT * REPLACE (coalesce(lag(close) OVER {W}, open) AS open) FROM c0",
    "bars": f"SELECT symbol, {typed('symbol')}, expiry, ts, open, greatest(high, open) AS high, least(low, open) AS low, close, volume FROM c1",
    "spot": candles("ticks", slot(120), "1 AS one").replace("GROUP BY 1 AS one, ", "GROUP BY "),
    "spot60": candles("ticks", slot(60), "1 AS one").replace("GROUP BY 1 AS one, ", "GROUP BY "),
    "spot30": candles("ticks", slot(30), "1 AS one").replace("GROUP BY 1 AS one, ", "GROUP BY "),
    "b": (
        f"SELECT *, row_number() OVER {W} AS n, count(*) OVER (PARTITION BY symbol, expiry) AS size, abs(close - open) AS body, "
        "max(high) OVER (PARTITION BY symbol, expiry ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS pk, "
        "arg_max(n0, (high, -n0)) OVER (PARTITION BY symbol, expiry ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - n0 AS pkn "
        f"FROM (SELECT *, row_number() OVER {W} AS n0 FROM bars)"
    ),
    # Red runs: number the starts, sum up each run, look at the green bar after it.
    "rr": f"SELECT *, (close < open AND n > 1) AS red FROM b WHERE size >= 5",
    "rs": f"SELECT *, coalesce(lag(red) OVER {W}, false) AS prev, lag(body) OVER {W} AS pbody FROM rr",
    "rn": f"SELECT *, sum(CASE WHEN red AND NOT (prev AND body < pbody) THEN 1 ELSE 0 END) OVER {W} AS run FROM rs",
    "ra": "SELECT symbol, expiry, run, count(*) AS len, arg_min(body, ts) AS fb, arg_max(body, ts) AS lb, min(ts) AS start, sum(low) AS lows, min(low) AS rlow, max(high) AS rhigh FROM rn WHERE red GROUP BY ALL",
    "rg": "SELECT g.*, a.len, a.fb, a.lb, a.start, a.lows, a.rlow, a.rhigh FROM rn g JOIN ra a USING (symbol, expiry, run) WHERE g.close > g.open AND g.prev AND a.len >= 3",
    "rsq": "SELECT *, fb / lb AS r1, fb / body AS r2 FROM rg",
    "osq": f"SELECT *, {AVERAGE} AS av FROM {asof('rg', 'start')} WHERE {OTM}",
    # Green chains; every second equal step begins a new run (one is allowed).
    "ga": "SELECT *, (close > open AND n > 1) AS g FROM b WHERE size >= 5",
    "gb": f"SELECT *, g AND coalesce(lag(g) OVER {W}, false) AND body >= lag(body) OVER {W} AS chained, lag(body) OVER {W} AS pbody FROM ga",
    "gc": f"SELECT *, sum(CASE WHEN g AND NOT chained THEN 1 ELSE 0 END) OVER {W} AS chain FROM gb",
    "gd": "SELECT *, CASE WHEN chained AND body = pbody THEN 1 ELSE 0 END AS eq FROM gc WHERE g",
    "ge": "SELECT *, sum(eq) OVER (PARTITION BY symbol, expiry, chain ORDER BY ts) // 2 AS part FROM gd",
    "gf": "SELECT symbol, expiry, chain, part, count(*) AS len, min(ts) AS start, max(ts) AS ts, arg_min(body, ts) AS fb, sum(low) AS lows0, min(low) AS rlow, max(high) AS rhigh, sum(eq) - max(CASE WHEN part > 0 THEN 1 ELSE 0 END) AS equal FROM ge GROUP BY symbol, expiry, chain, part HAVING count(*) >= 3",
    "gg": "SELECT e.*, f.len, f.start, f.fb, f.lows0, f.rlow, f.rhigh, f.equal FROM gf f JOIN ge e USING (symbol, expiry, chain, part, ts)",
    "gst": f"SELECT *, (lows0 + close) / (len + 1.0) AS av FROM {asof('gg', 'start')} WHERE {OTM}",
    "wa": f"SELECT *, {lags(5)} AS dist, lag(ts, 5) OVER {W} AS start, (open = close AND high = low AND open = high)::INT AS dead, min(low) OVER {W[:-1]} ROWS 5 PRECEDING) AS rlow, max(high) OVER {W[:-1]} ROWS 5 PRECEDING) AS rhigh FROM b WHERE size >= 7",
    "wb": f"SELECT *, CASE WHEN dist > 0 AND ({' + '.join(f'lag(dead, {k}) OVER {W}' for k in range(1, 6))}) < 5 AND open * close * dist * dist > 0 THEN log10(open * close * dist * dist) END AS wv FROM wa",
    "wc": f"SELECT *, greatest({', '.join(f'CASE WHEN wv - lag(wv, {k}) OVER {W} >= 0.3 AND close >= 1.35 * lag(close, {k}) OVER {W} THEN wv - lag(wv, {k}) OVER {W} END' for k in (1, 2))}) AS jump FROM wb",
    "wal": f"SELECT * FROM {asof('(SELECT * FROM wc WHERE close > open AND jump IS NOT NULL)', 'start')} WHERE {OTM}",
    "sig0": (
        f"SELECT 'red_squeeze' AS signal, symbol, expiry, typ, strike, ts, start, {r('greatest(r1, r2)', 3)} AS value, close, high, low, open, pk, pkn, NULL::DOUBLE AS dist_pct, NULL::DOUBLE AS avg_price, NULL::DOUBLE AS sp0, NULL::DOUBLE AS ph, {r('least(rlow, low)', 3)} AS pl FROM rsq "
        f"UNION ALL SELECT 'otm_red_squeeze', symbol, expiry, typ, strike, ts, start, CASE WHEN av > 0 AND sp > 0 THEN {r('sp / av', 3)} ELSE 0 END, close, high, low, open, pk, pkn, {DISTANCE}, {r('av', 4)}, {r('sp', 3)}, greatest(rhigh, high), {r('least(rlow, low)', 4)} FROM osq "
        f"UNION ALL SELECT 'green_stairs', symbol, expiry, typ, strike, ts, start, CASE WHEN av > 0 AND sp > 0 THEN {r('sp / av', 3)} ELSE 0 END, close, high, low, open, pk, pkn, {DISTANCE}, {r('av', 4)}, {r('sp', 3)}, rhigh, {r('rlow', 4)} FROM gst "
        f"UNION ALL SELECT 'otm_wall', symbol, expiry, typ, strike, ts, start, {r('jump', 3)}, close, high, low, open, pk, pkn, {DISTANCE}, NULL, {r('sp', 3)}, rhigh, {r('rlow', 4)} FROM wal"
    ),
    "sig1": f"SELECT x.*, {STATE.replace('high', 'x.high')} AS state, {RATIO.replace('high', 'x.high')} AS ratio, s.open AS so, s.high AS sh, s.low AS sl, s.close AS sc FROM sig0 x ASOF LEFT JOIN spot s ON x.ts >= s.ts WHERE ({SETTLE} - x.ts) / 3600.0 >= 1.5",
    "sig": "SELECT * FROM sig1 WHERE NOT coalesce(sh > sl AND abs(sc - so) / (sh - sl) >= 0.6 AND CASE WHEN typ = 'C' THEN sc < so ELSE sc > so END, false)",
    "cand": f"SELECT symbol AS s, typ, strike, expiry, ts, pk / close AS rr, sp FROM {asof('b', 'ts')} WHERE close > 0 AND pk IS NOT NULL AND pk / close > 0",
    "uni": (
        "SELECT * FROM (SELECT g.signal, g.symbol, g.expiry, g.ts, c.rr, c.s, row_number() OVER (PARTITION BY g.signal, g.symbol, g.expiry, g.ts ORDER BY c.rr DESC, c.s) AS k FROM sig g JOIN cand c ON c.typ = g.typ AND c.expiry = g.expiry AND c.ts = g.ts "
        "AND (g.signal = 'red_squeeze' OR c.sp IS NULL OR CASE WHEN c.typ = 'C' THEN c.strike > c.sp ELSE c.strike < c.sp END)) WHERE k = 1"
    ),
    "sigs": f"SELECT g.*, coalesce({r('u.rr', 3)}, 0.0) AS univ_ratio, u.s AS univ_symbol FROM sig g LEFT JOIN uni u USING (signal, symbol, expiry, ts)",
    "isl": (
        "SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY signal, expiry, typ ORDER BY start, ts, symbol) AS island FROM "
        "(SELECT *, max(ts) OVER (PARTITION BY signal, expiry, typ ORDER BY start, ts, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sigs)"
    ),
    "ev": (
        "SELECT signal, expiry, 120 AS duration, typ AS type, min(start) AS start_ts, max(ts) AS end_ts, count(*)::INT AS n, max(value) AS max_value, max(ratio) AS max_ratio, "
        "CASE WHEN bool_or(state = 'activated') THEN 'activated' WHEN bool_or(state = 'pending') THEN 'pending' ELSE 'slHit' END AS state, "
        "string_agg(symbol, ',' ORDER BY symbol) AS instruments, list(symbol) AS syms, max(univ_ratio) AS univ_ratio, "
        "CASE WHEN max(univ_ratio) > 0 THEN first(univ_symbol ORDER BY univ_ratio DESC, univ_symbol) END AS univ_symbol FROM isl GROUP BY signal, expiry, typ, island"
    ),
    "evm0": "SELECT signal, expiry, type, start_ts, unnest(CASE WHEN univ_symbol IS NOT NULL THEN [univ_symbol] ELSE syms END) AS sym FROM ev",
    "evm": (
        "SELECT signal, expiry, type, start_ts, avg(CASE WHEN sp > 0 THEN (CASE WHEN split_part(sym, '-', 1) = 'C' THEN 1.0 ELSE -1.0 END) * (split_part(sym, '-', 3)::DOUBLE - sp) / sp * 100 END) AS m "
        f"FROM {asof('evm0', 'start_ts')} GROUP BY ALL"
    ),
    "tag": (
        f"SELECT e.*, m, ({SETTLE} - start_ts) / 3600.0 AS tteh, CASE WHEN ({SETTLE} - start_ts) / 3600.0 < 6 THEN 0 WHEN ({SETTLE} - start_ts) / 3600.0 < 48 THEN 1 WHEN ({SETTLE} - start_ts) / 3600.0 < 120 THEN 2 WHEN ({SETTLE} - start_ts) / 3600.0 < 480 THEN 3 ELSE 4 END AS tte, "
        "CASE WHEN m IS NULL THEN NULL WHEN m < -12.5 THEN 0 WHEN m < -9 THEN 1 WHEN m < -6 THEN 2 WHEN m < -3.5 THEN 3 WHEN m < -1.5 THEN 4 WHEN m < 1.5 THEN 5 WHEN m < 3.5 THEN 6 WHEN m < 6 THEN 7 WHEN m < 9 THEN 8 WHEN m < 12.5 THEN 9 ELSE 10 END AS mb "
        "FROM ev e LEFT JOIN evm USING (signal, expiry, type, start_ts)"
    ),
    "un0": (
        "SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY expiry, typ ORDER BY start, ts, symbol) AS island FROM "
        "(SELECT *, max(ts) OVER (PARTITION BY expiry, typ ORDER BY start, ts, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sigs WHERE signal = 'otm_wall')"
    ),
    "units": (
        "SELECT expiry, 120 AS duration, typ AS type, count(*)::INT AS n, min(start) AS start_ts, max(ts) AS end_ts, first(symbol ORDER BY ratio DESC, start, symbol DESC) AS symbol, max(ratio) AS ratio, max(univ_ratio) AS univ_ratio, "
        "bool_or(ratio >= 2) AS win, list_sort(list_distinct(list(symbol))) AS syms, first(start ORDER BY start, symbol) AS pattern_start FROM un0 GROUP BY expiry, typ, island"
    ),
    "ux": "SELECT expiry, row_number() OVER (ORDER BY expiry) AS i, count(*) OVER () AS nn FROM (SELECT DISTINCT expiry FROM {source})",
    "fp": (
        "SELECT f AS fold, CASE WHEN nn < 6 THEN greatest(1, floor(nn * 0.7)) ELSE greatest(1, nn // 2) + (f - 1) * greatest(1, (nn - greatest(1, nn // 2)) // 3) END::BIGINT AS a, "
        "CASE WHEN nn < 6 OR f = 3 THEN nn ELSE greatest(1, nn // 2) + f * greatest(1, (nn - greatest(1, nn // 2)) // 3) END AS e FROM (SELECT max(nn) AS nn FROM ux), generate_series(1, 3) g(f) WHERE nn >= 6 OR f = 1"
    ),
    "fo": "SELECT fold::INT AS fold, x.expiry AS train_end, y.expiry AS test_end FROM fp JOIN ux x ON x.i = fp.a JOIN ux y ON y.i = fp.e",
    "sided": (
        "SELECT u.*, fold, train_end, test_end, CASE WHEN expiry <= train_end THEN 'train' WHEN expiry > test_end THEN 'unused' "
        "WHEN to_timestamp(pattern_start + 19800)::TIMESTAMP::DATE <= train_end THEN 'purge' ELSE 'test' END AS side FROM units u, fo"
    ),
    "wf0": (
        "SELECT fold, train_end::VARCHAR AS train_end, test_end::VARCHAR AS test_end, count(*) FILTER (side = 'train') AS train_n, count(*) FILTER (side = 'train' AND win) AS train_wins, "
        "count(*) FILTER (side = 'test') AS test_n, count(*) FILTER (side = 'test' AND win) AS test_wins, count(*) FILTER (side = 'purge') AS purged FROM sided GROUP BY ALL"
    ),
    "wf1": f"SELECT *, CASE WHEN train_n > 0 THEN {r('train_wins * 100.0 / train_n', 1)} END AS train_pct, CASE WHEN test_n > 0 THEN {r('test_wins * 100.0 / test_n', 1)} END AS test_pct FROM wf0",
    "wf": f"SELECT *, {r('train_pct - test_pct', 1)} AS gap, test_n < 3 AS thin FROM wf1",
    "bt0": "SELECT x.symbol, x.expiry, x.typ, x.strike, x.ts AS ets, x.close AS ep, x.n AS en, y.ts AS pts, y.high AS pp, y.n AS pn, y.high / x.close AS rr FROM b x JOIN b y ON x.symbol = y.symbol AND x.expiry = y.expiry AND y.n > x.n WHERE x.close > 0 AND y.high > 0",
    "bt": (
        f"SELECT symbol, expiry, typ, strike, {r('rr', 2)} AS ratio, ets AS entry_ts, ep AS entry_price, pts AS peak_ts, pp AS peak_price, (pn - en)::INT AS hold_candles, {r('(pts - ets) / 3600.0', 1)} AS hold_hours, f AS first_ts, c AS candles FROM "
        "(SELECT *, row_number() OVER (PARTITION BY symbol, expiry ORDER BY rr DESC, en DESC, pp DESC, pn DESC) AS k FROM bt0) JOIN (SELECT symbol, expiry, min(ts) AS f, count(*) AS c FROM b GROUP BY ALL) USING (symbol, expiry) WHERE k = 1"
    ),
    # Averages by recursion from the mean of the first bars.
    "e5": "SELECT symbol, expiry, 5::BIGINT AS n, avg(close) AS ema FROM b WHERE n <= 5 GROUP BY ALL HAVING count(*) = 5 UNION ALL SELECT x.symbol, x.expiry, y.n, y.close * (2 / 6.0::DOUBLE) + x.ema * (1 - 2 / 6.0::DOUBLE) FROM e5 x JOIN b y ON y.symbol = x.symbol AND y.expiry = x.expiry AND y.n = x.n + 1",
    "e10": "SELECT symbol, expiry, 10::BIGINT AS n, avg(close) AS ema FROM b WHERE n <= 10 GROUP BY ALL HAVING count(*) = 10 UNION ALL SELECT x.symbol, x.expiry, y.n, y.close * (2 / 11.0::DOUBLE) + x.ema * (1 - 2 / 11.0::DOUBLE) FROM e10 x JOIN b y ON y.symbol = x.symbol AND y.expiry = x.expiry AND y.n = x.n + 1",
    # Stretches of bars, each split at its trade.
    "tl": "SELECT symbol, expiry, list(high ORDER BY ts) AS hs, list(low ORDER BY ts) AS ls, list(ts ORDER BY ts) AS tss FROM bars GROUP BY symbol, expiry",
    "tr": (
        "SELECT symbol, expiry, hs, ls, tss, 1::BIGINT AS lo, len(hs)::BIGINT AS hi FROM tl UNION ALL SELECT symbol, expiry, hs, ls, tss, p.lo, p.hi FROM (SELECT *, unnest(CASE WHEN h = lo THEN [{'lo': lo + 1, 'hi': hi}] ELSE [{'lo': lo, 'hi': l - 1}, {'lo': h + 1, 'hi': hi}] END) AS p "
        "FROM (SELECT *, CASE WHEN h > lo THEN lo + list_position(ls[lo:h - 1], list_min(ls[lo:h - 1])) - 1 END AS l FROM (SELECT *, lo + list_position(hs[lo:hi], list_max(hs[lo:hi])) - 1 AS h FROM tr WHERE hi > lo)))"
    ),
    "tx": (
        "SELECT symbol, expiry, split_part(symbol, '-', 1) AS type, tss[l] AS low_ts, tss[h] AS high_ts, ls[l] AS low_price, hs[h] AS high_price, (h - l)::INT AS hold_candles, floor(hs[h] / ls[l] * 1e2 + 0.5) / 1e2 AS ratio FROM "
        "(SELECT *, lo + list_position(ls[lo:h - 1], list_min(ls[lo:h - 1])) - 1 AS l FROM (SELECT *, lo + list_position(hs[lo:hi], list_max(hs[lo:hi])) - 1 AS h FROM tr WHERE hi > lo) WHERE h > lo) WHERE ls[l] > 0 AND hs[h] > 0"
    ),
    "to2": "SELECT *, row_number() OVER (PARTITION BY expiry, type ORDER BY low_ts, symbol, high_ts) AS i FROM tx WHERE ratio >= 2",
    "tm": (
        "SELECT *, high_ts AS ends, 0 AS event FROM to2 WHERE i = 1 UNION ALL SELECT y.*, CASE WHEN y.low_ts <= x.ends AND greatest(x.ends, y.high_ts) - x.ends <= 216000 THEN greatest(x.ends, y.high_ts) ELSE y.high_ts END, "
        "CASE WHEN y.low_ts <= x.ends AND greatest(x.ends, y.high_ts) - x.ends <= 216000 THEN x.event ELSE x.event + 1 END FROM tm x JOIN to2 y ON y.expiry = x.expiry AND y.type = x.type AND y.i = x.i + 1"
    ),
    "te": (
        "SELECT expiry, type, min(low_ts) AS start_ts, max(high_ts) AS end_ts, count(*)::INT AS n, max(ratio) AS max_ratio, first(symbol ORDER BY ratio DESC, low_ts, symbol DESC) AS max_symbol, first(low_price ORDER BY ratio DESC, low_ts, symbol DESC) AS max_low, "
        "first(high_price ORDER BY ratio DESC, low_ts, symbol DESC) AS max_high, floor(avg(hold_candles) + 0.5)::INT AS hold_candles, string_agg(symbol, ',' ORDER BY ratio DESC, low_ts, symbol, high_ts) AS instruments FROM tm GROUP BY expiry, type, event"
    ),
}


def _needs(sql: str, found: list[str], inside: tuple[str, ...] = ()) -> list[str]:
    """Common tables that a query uses, those they use first."""
    import re

    for name in re.findall(r"\b(?:FROM|JOIN|,)\s*\(*\s*(\w+)", sql):
        if name in TABLES and name not in found and name not in inside:
            _needs(TABLES[name].replace("{source}", "units"), found, (*inside, name))
            found.append(name)
    return found


def build(sql: str, source: str = "units") -> str:
    names = _needs(sql.replace("{source}", source), [])
    if "ux" in names and source not in names:
        names = [*_needs(f"FROM {source}", []), *[n for n in names if n not in _needs(f"FROM {source}", [])]]
    tables = ", ".join(f"{n} AS ({TABLES[n].replace('{source}', source)})" for n in names)
    return f"WITH RECURSIVE {tables} {sql}" if tables else sql


def hits(col: str, thresholds: tuple, prefix: str = "hit") -> str:
    return ", ".join(f"count(*) FILTER ({col} >= {t}) AS {prefix}_{t}x" for t in thresholds)


def pct(thresholds: tuple) -> str:
    return ", ".join(f"CASE WHEN n > 0 THEN {r(f'hit_{t}x * 100.0 / n', 1)} ELSE 0.0 END AS pct_{t}x" for t in thresholds)


def zeros(names: list[str]) -> str:
    return ", ".join(f"coalesce({c}, 0) AS {c}" for c in names)


def axis(labels: list[str]) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(labels)) + ")"


def band(col: str, uppers: list[float]) -> str:
    return "CASE " + " ".join(f"WHEN {col} < {u} THEN {i}" for i, u in enumerate(uppers)) + f" ELSE {len(uppers)} END"


T3 = (2, 5, 10)
HIT3 = [f"hit_{t}x" for t in T3]
TTE = ["0-6h", "6-48h", "48-120h", "120-480h", "480h+"]
MONEY = ["12.5%+ ITM", "9-12.5% ITM", "6-9% ITM", "3.5-6% ITM", "1.5-3.5% ITM", "±1.5%", "1.5-3.5% OTM", "3.5-6% OTM", "6-9% OTM", "9-12.5% OTM", "12.5%+ OTM"]
RATIOS = [2, 5, 10, 50]
NOW = 1_705_406_400
D = "expiry::VARCHAR AS expiry"
SHOWN = (
    f"symbol, {D}, ts AS entry_ts, close AS entry_price, start AS pattern_start, len::INT AS seq_length, {r('fb', 3)} AS first_body, {{last}} AS last_body, {r('body', 3)} AS trigger_body, "
    f"{{low}} AS pattern_low, {{ratios}}, {{value}} AS signal_value, {{trigger}} AS trigger_price, {STATE} AS state, {RATIO} AS ratio"
)
RUN = {"last": r("lb", 3), "ratios": f"{r('fb / lb', 3)} AS ratio1, {r('fb / body', 3)} AS ratio2"}
VALUE = f"CASE WHEN av > 0 AND sp > 0 THEN {r('sp / av', 3)} ELSE 0.0 END"
SQL: dict[str, str] = {
    "ohlcv_60m": candles("ticks", slot(60), "symbol"),
    "ohlcv_multi": " UNION ALL ".join(
        f"SELECT symbol, {m}::INT AS duration, {slot(m, 'ts')} AS ts, arg_min(open, ts) AS open, max(high) AS high, coalesce(min(nullif(low, 0)), 0.0) AS low, arg_max(close, ts) AS close, sum(volume) AS volume "
        f"FROM ({candles('ticks', slot(30), 'symbol')}) GROUP BY symbol, {slot(m, 'ts')}" for m in (60, 240, 1440)
    ) + f" UNION ALL SELECT symbol, 90::INT, s AS ts, arg_min(open, ts), max(high), coalesce(min(nullif(low, 0)), 0.0), arg_max(close, ts), sum(volume) FROM (SELECT *, {slot(90, 'ts')} AS s FROM ({candles('ticks', slot(30), 'symbol')})) GROUP BY symbol, s",
    "daily_bars_supplier": (
        "SELECT 'S-' || l_suppkey AS symbol, floor(epoch(l_shipdate) / 86400)::BIGINT * 86400 AS ts, first(p ORDER BY q) AS open, max(p) AS high, min(p) AS low, last(p ORDER BY q) AS close, sum(l_quantity) AS volume "
        "FROM (SELECT *, l_extendedprice / l_quantity AS p, l_orderkey * 100 + l_linenumber AS q FROM lineitem) GROUP BY 1, 2"
    ),
    "chain_candles": f"SELECT symbol, {D}, ts, open, high, low, close, volume FROM bars",
    "warmup_strip": (
        f"SELECT symbol, {D}, ts, close FROM (SELECT *, row_number() OVER {W} AS k FROM (SELECT *, min(CASE WHEN low > 0.1 THEN ts END) OVER (PARTITION BY symbol, expiry) AS f FROM bars) WHERE ts >= f) WHERE k > 1"
    ),
    "dte_trim": f"SELECT symbol, {D}, ts, close FROM bars WHERE ({SETTLE} - ts) / 3600.0 <= 25",
    "peak_after": f"SELECT symbol, {D}, ts, pk AS peak_after, pkn::INT AS peak_bars FROM b",
    "supplier_peak_after": (
        "SELECT symbol, ts, close, max(high) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS peak_after FROM "
        "(SELECT 'S-' || l_suppkey AS symbol, floor(epoch(l_shipdate) / 86400)::BIGINT * 86400 AS ts, max(p) AS high, last(p ORDER BY q) AS close FROM (SELECT *, l_extendedprice / l_quantity AS p, l_orderkey * 100 + l_linenumber AS q FROM lineitem) GROUP BY 1, 2)"
    ),
    "asof_spot": f"SELECT symbol, {D}, x.ts, s.close AS spot_close FROM bars x ASOF LEFT JOIN (SELECT ts + 1800 AS ts, close FROM spot60) s ON x.ts >= s.ts",
    "moneyness_at_bar": f"SELECT symbol, {D}, ts, {OTM} AS otm, {DISTANCE} AS distance_pct FROM {asof('bars', 'ts')}",
    "spot_series": (
        f"SELECT 90::INT AS duration, s AS ts, arg_min(open, ts) AS open, max(high) AS high, coalesce(min(nullif(low, 0)), 0.0) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM (SELECT *, {slot(90, 'ts')} AS s FROM spot30) GROUP BY s "
        f"UNION ALL SELECT 120::INT, s, arg_min(open, ts), max(high), coalesce(min(nullif(low, 0)), 0.0), arg_max(close, ts), sum(volume) FROM (SELECT *, {slot(120, 'ts')} AS s FROM spot60) GROUP BY s"
    ),
    "latest_spot_close": "SELECT 'EVT' AS spot, arg_max(close, ts) AS close FROM spot30",
    "red_squeeze": f"SELECT {SHOWN.format(**RUN, low=r('least(rlow, low)', 3), value=r('greatest(r1, r2)', 3), trigger=r('high', 3))} FROM rsq",
    "otm_red_squeeze": f"SELECT {SHOWN.format(**RUN, low=r('least(rlow, low)', 4), value=VALUE, trigger=r('high', 4))}, greatest(rhigh, high) AS pattern_high, {r('av', 4)} AS avg_price, {r('sp', 3)} AS spot_price, {DISTANCE} AS distance_pct FROM osq",
    "green_stairs": f"SELECT {SHOWN.format(last=r('body', 3), ratios=r('body / fb', 3) + ' AS ratio1, 0.0::DOUBLE AS ratio2', low=r('rlow', 4), value=VALUE, trigger=r('high', 4))}, equal::INT AS equal_steps, rhigh AS pattern_high, {r('av', 4)} AS avg_price FROM gst",
    "otm_wall": f"SELECT symbol, {D}, ts AS entry_ts, start AS pattern_start, {r('dist', 4)} AS dist, {r('wv', 3)} AS log_value, {r('jump', 3)} AS signal_value, rhigh AS pattern_high, {r('rlow', 4)} AS pattern_low, {STATE} AS state, {RATIO} AS ratio FROM wal",
    "outcomes": (
        f"SELECT signal, symbol, {D}, ts AS entry_ts, CASE WHEN signal = 'red_squeeze' THEN {r('high', 3)} ELSE {r('high', 4)} END AS trigger_price, coalesce(CASE WHEN signal = 'red_squeeze' THEN {r('pk', 3)} ELSE {r('pk', 4)} END, 0.0) AS peak_after, ratio, state, coalesce(pk > high, false) AS broke_out, pkn::INT AS hold_candles FROM sig"
    ),
    "firing_cutoff": f"SELECT symbol, {D}, ts AS entry_ts, {RATIO} AS ratio FROM rsq WHERE ({SETTLE} - ts) / 3600.0 >= 24",
    "opposite_filter": (
        f"SELECT symbol, {D}, x.ts AS entry_ts, {RATIO.replace('high', 'x.high')} AS ratio FROM rsq x ASOF LEFT JOIN spot s ON x.ts >= s.ts WHERE NOT coalesce(s.high > s.low AND abs(s.close - s.open) / (s.high - s.low) >= 0.3 AND CASE WHEN typ = 'C' THEN s.close < s.open ELSE s.close > s.open END, false)"
    ),
}
for _name, _rule in (
    ("universe_max", "true"),
    ("universe_further_otm", "CASE WHEN c.typ = 'C' THEN c.strike >= g.strike ELSE c.strike <= g.strike END"),
    ("universe_otm", "(c.sp IS NULL OR CASE WHEN c.typ = 'C' THEN c.strike > c.sp ELSE c.strike < c.sp END)"),
):
    SQL[_name] = (
        f"SELECT symbol, {D}, ts AS entry_ts, coalesce({r('rr', 3)}, 0.0) AS univ_ratio, s AS univ_symbol FROM (SELECT g.symbol, g.expiry, g.ts, c.rr, c.s, row_number() OVER (PARTITION BY g.symbol, g.expiry, g.ts ORDER BY c.rr DESC NULLS LAST, c.s) AS k "
        f"FROM rsq g LEFT JOIN cand c ON c.typ = g.typ AND c.expiry = g.expiry AND c.ts = g.ts AND {_rule}) WHERE k = 1"
    )
_BEST3 = ", ".join(f"coalesce(n >= 3 AND pct_{t}x > 0 AND pct_{t}x = max(CASE WHEN n >= 3 THEN pct_{t}x END) OVER (), false) AS best_{t}x" for t in T3)
_MARK = "n < 3 AS thin, coalesce(n >= 3 AND pct_{t}x = max(CASE WHEN n >= 3 THEN pct_{t}x END) OVER () AND max(CASE WHEN n >= 3 THEN pct_{t}x END) OVER () > 0, false) AS best"
_SIDES = "count(*) FILTER (type = 'C') AS calls, count(*) FILTER (type = 'P') AS puts"
_OPEN = f"SELECT expiry, min(ts) AS listed_ts FROM bars GROUP BY expiry HAVING min(ts) <= {NOW} AND epoch(expiry)::BIGINT > {NOW}"
_RED = [25, 40, 80, 200]
_WALL = [2.5, 3, 4, 6]
_CELLS = ", ".join(f"count(*) FILTER ({k} = {i}) AS {n}_{i}" for k, n in (("f", "fired"), ("u", "universe")) for i in range(5))
SQL |= {
    "merge_events": f"SELECT signal, {D}, duration, type, start_ts, end_ts, n, max_value, max_ratio, state, instruments, univ_ratio, univ_symbol FROM ev",
    "quality_by_type": f"SELECT *, {pct(T3)} FROM (SELECT signal, type, count(*) AS n, count(*) FILTER (state = 'activated') AS activated, count(*) FILTER (state = 'slHit') AS slHit, count(*) FILTER (state = 'pending') AS pending, {hits('univ_ratio', T3)} FROM ev GROUP BY ALL)",
    "breakdown_tte": f"SELECT *, {_BEST3} FROM (SELECT *, {pct(T3)} FROM (SELECT a.i::INT AS tte, a.l AS tte_label, {zeros(['n', *HIT3])} FROM {axis(TTE)} a(i, l) LEFT JOIN (SELECT tte, count(*) AS n, {hits('max_ratio', T3)} FROM tag GROUP BY tte) g ON g.tte = a.i))",
    "crosstab_tte_moneyness": (
        f"SELECT *, {_MARK.format(t=10)} FROM (SELECT *, {pct((10,))} FROM (SELECT a.i::INT AS tte, a.l AS tte_label, c.i::INT AS moneyness_bucket, c.l AS moneyness_bucket_label, {zeros(['n', 'hit_10x'])} FROM {axis(TTE)} a(i, l) CROSS JOIN {axis(MONEY)} c(i, l) "
        f"LEFT JOIN (SELECT tte, mb, count(*) AS n, {hits('univ_ratio', (10,))} FROM tag WHERE mb IS NOT NULL GROUP BY ALL) g ON g.tte = a.i AND g.mb = c.i))"
    ),
    "breakdown3": (
        f"SELECT *, {_MARK.format(t=5)} FROM (SELECT *, {pct(T3)} FROM (SELECT s.x AS signal, y.x AS type, a.i::INT AS tte, a.l AS tte_label, {zeros(['n', *HIT3])} FROM (VALUES ('red_squeeze'), ('otm_red_squeeze'), ('green_stairs'), ('otm_wall')) s(x) CROSS JOIN (VALUES ('C'), ('P')) y(x) CROSS JOIN {axis(TTE)} a(i, l) "
        f"LEFT JOIN (SELECT signal, type, tte, count(*) AS n, {hits('univ_ratio', T3)} FROM tag GROUP BY ALL) g ON g.signal = s.x AND g.type = y.x AND g.tte = a.i))"
    ),
    "moneyness_excluded": "SELECT count(*) FILTER (mb IS NULL) AS excluded FROM tag",
    "event_moneyness": f"SELECT signal, {D}, type, start_ts, {r('m', 6)} AS moneyness, mb::INT AS moneyness_bucket, tte::INT AS tte FROM tag",
    "heat_matrix": f"SELECT a.i::INT AS strength, a.l AS label, {zeros(['total', *[f'{n}_{i}' for n in ('fired', 'universe') for i in range(5)]])} FROM {axis(['15-25', '25-40', '40-80', '80-200', '200+'])} a(i, l) LEFT JOIN (SELECT s, count(*) AS total, {_CELLS} FROM (SELECT {band('max_value', _RED)} AS s, {band('max_ratio', RATIOS)} AS f, {band('univ_ratio', RATIOS)} AS u FROM ev WHERE signal = 'red_squeeze') GROUP BY s) g ON g.s = a.i",
    "cumulative_matrix": f"SELECT *, {pct(T3)} FROM (SELECT a.i::INT AS strength, a.l AS label, {zeros(['n', *HIT3])} FROM {axis(['2-2.5', '2.5-3', '3-4', '4-6', '6+'])} a(i, l) LEFT JOIN (SELECT {band('max_value', _WALL)} AS s, count(*) AS n, {hits('max_ratio', T3)} FROM ev WHERE signal = 'otm_wall' GROUP BY s) g ON g.s = a.i)",
    "hit_tree": f"SELECT duration, {D}, count(*) AS n, {hits('max_ratio', T3, 'fired')}, {hits('univ_ratio', T3, 'universe')} FROM ev GROUP BY GROUPING SETS ((duration, expiry), (duration), ())",
    "expiry_grid": f"SELECT {D}, count(*) FILTER (max_ratio >= 2 AND duration = 60) AS d60, count(*) FILTER (max_ratio >= 2 AND duration = 120) AS d120, count(*) FILTER (max_ratio >= 2) AS hits, count(*) AS n FROM ev GROUP BY expiry",
    "expiry_summary": f"SELECT signal, 'EVT' AS spot, {D}, '120' AS durations, {_SIDES}, coalesce(max(max_ratio) FILTER (type = 'C'), 0.0) AS best_call, coalesce(max(max_ratio) FILTER (type = 'P'), 0.0) AS best_put, coalesce(max(univ_ratio) FILTER (type = 'C'), 0.0) AS univ_call, coalesce(max(univ_ratio) FILTER (type = 'P'), 0.0) AS univ_put FROM ev GROUP BY signal, expiry",
    "calendar": (
        f"SELECT d::DATE::VARCHAR AS day, calls, puts, best_call, strftime(d, '%Y-%m') AS month, (isodow(d) - 1)::INT AS weekday FROM (SELECT unnest(generate_series(min(expiry), max(expiry), INTERVAL 1 DAY)) AS d FROM ev WHERE signal = 'otm_wall') "
        f"LEFT JOIN (SELECT expiry, {_SIDES}, coalesce(max(max_ratio) FILTER (type = 'C'), 0.0) AS best_call FROM ev WHERE signal = 'otm_wall' GROUP BY expiry) g ON g.expiry = d::DATE"
    ),
    "panels": f"SELECT {D}, duration, type, best, n, (rank() OVER (PARTITION BY expiry, type ORDER BY best DESC))::INT AS rank FROM (SELECT expiry, duration, type, max(max_ratio) AS best, count(*) AS n FROM ev GROUP BY ALL)",
    "panel_events": f"SELECT {D}, type, start_ts, max_ratio, k::INT AS nth FROM (SELECT *, row_number() OVER (PARTITION BY expiry, duration, type ORDER BY max_ratio DESC, start_ts) AS k FROM ev WHERE signal = 'otm_wall') WHERE k <= 5",
    "decorated": f"SELECT {D}, type, start_ts, max_ratio, ({band('max_value', _RED)})::INT AS strength_band, ({band('max_ratio', RATIOS)})::INT AS fired_band, ({band('univ_ratio', RATIOS)})::INT AS univ_band FROM ev WHERE signal = 'red_squeeze' AND max_ratio >= 1 AND max_value >= 2",
    "calibrated": f"SELECT *, CASE WHEN n > 0 THEN {r('successes * 100.0 / n', 1)} ELSE 0.0 END AS pct FROM (SELECT count(*) AS n, count(*) FILTER (univ_ratio >= 10) AS successes, count(*) FILTER (univ_ratio < 10) AS failures FROM ev WHERE signal = 'otm_wall' AND max_value >= 0.4 AND max_value < 1.5 AND n >= 2 AND type = 'C')",
    "alive_expiries": f"SELECT {D}, listed_ts FROM ({_OPEN})",
    "heatmap": (
        f"SELECT a.expiry::VARCHAR AS expiry, a.slot, coalesce(fired, 0) AS fired, coalesce(names, '') AS names FROM (SELECT expiry, unnest(generate_series({NOW} // 7200 * 7200 - 35 * 7200, {NOW} // 7200 * 7200, 7200)) AS slot FROM ({_OPEN})) a LEFT JOIN "
        "(SELECT expiry, slot, len(l) AS fired, array_to_string(l[1:14], ',') AS names FROM (SELECT expiry, end_ts // 7200 * 7200 AS slot, list_sort(list_distinct(flatten(list(syms)))) AS l FROM ev WHERE signal = 'otm_wall' AND type = 'C' "
        f"AND end_ts <= {NOW} GROUP BY ALL)) g ON g.expiry = a.expiry AND g.slot = a.slot"
    ),
    "timeline": "SELECT end_ts, min(max_value) AS least, max(max_value) AS most, count(*) AS n FROM ev GROUP BY end_ts",
    "silent_durations": "SELECT d::INT AS duration FROM (VALUES (60), (120), (240)) x(d) WHERE d NOT IN (SELECT duration FROM ev)",
    "pattern_rows": (
        f"SELECT signal, symbol, typ AS type, strike, {D}, ts AS entry_ts, {r(f'({SETTLE} - start) / 3600.0', 2)} AS tte_hours, {r(f'({SETTLE} - ts) / 3600.0', 2)} AS entry_tte_hours, dist_pct > 0 AS otm, dist_pct AS distance_pct, value AS signal_value, "
        f"{r('sp0 / nullif(avg_price, 0)', 4)} AS cheapness, univ_ratio FROM sigs"
    ),
    "entry_times": (
        f"SELECT signal, symbol, {D}, ts AS entry_ts, strftime(l, '%Y-%m-%dT%H:%M:%S') || '+0530' AS entry, hour(l)::INT AS entry_hour, minute(l)::INT AS entry_minute, isodow(l)::INT AS entry_weekday, l::DATE::VARCHAR AS entry_date "
        "FROM (SELECT *, TIMESTAMP '1970-01-01' + to_seconds(ts + 19800) AS l FROM sigs)"
    ),
    "ex_ante_filter": f"SELECT signal, symbol, {D}, ts AS entry_ts FROM sigs WHERE {r(f'({SETTLE} - start) / 3600.0', 2)} BETWEEN 12 AND 60 AND coalesce(dist_pct, 0) > -20 AND value >= 0.2",
    "derived_cols": (
        f"SELECT signal, symbol, {D}, ts AS entry_ts, {r('rel', 4)} AS rel, ratio - 1 > 0 AS win FROM (SELECT *, CASE WHEN close <> 0 THEN (coalesce(ph, 0) - coalesce(pl, 0)) / close ELSE 0 END AS rel FROM sigs) WHERE rel > 0.5"
    ),
    "unpopulated_fields": "SELECT f AS field FROM (VALUES ('distance_pct'), ('equal_steps'), ('dist')) x(f) WHERE (SELECT count(*) FROM sigs WHERE signal = 'red_squeeze') > 0",
    "merged_units": f"SELECT {D}, duration, type, start_ts, end_ts, n, symbol, ratio, univ_ratio, win, array_to_string(syms, ',') AS instruments FROM units",
    "folds": "SELECT fold, train_end::VARCHAR AS train_end, test_end::VARCHAR AS test_end FROM fo",
    "walk_forward": "SELECT * FROM wf",
    "oos_summary": f"SELECT {r('avg(CASE WHEN NOT thin THEN test_pct END)', 1)} AS oos_mean, {r('max(CASE WHEN NOT thin THEN test_pct END) - min(CASE WHEN NOT thin THEN test_pct END)', 1)} AS oos_spread, count(CASE WHEN NOT thin THEN test_pct END) AS folds FROM wf",
    "top_units": f"SELECT win, k::INT AS nth, {D}, type, symbol, ratio, array_to_string(syms[1:3], ',') AS instruments FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY CASE WHEN win THEN -ratio ELSE ratio END, start_ts, expiry, duration, type, symbol) AS k FROM units) WHERE k <= 20",
    "best_trade": f"SELECT symbol, {D}, ratio, entry_ts, entry_price, peak_ts, peak_price, hold_candles, hold_hours, first_ts, candles FROM bt",
    "best_trade_summary": (
        f"SELECT CASE WHEN grouping(expiry) = 0 THEN 'EVT' END AS spot, {D}, count(*) AS scanned, count(*) FILTER (ratio >= 5) AS qualifying, {hits('ratio', T3)}, max(ratio) AS best_ratio, first(symbol ORDER BY ratio DESC, symbol DESC) AS best_symbol FROM bt GROUP BY GROUPING SETS ((expiry), ())"
    ),
    "best_trade_moneyness": f"SELECT symbol, {D}, ratio, {r('sp', 2)} AS spot_at_entry, {r('(strike - sp) / sp * 100', 1)} AS entry_distance FROM {asof('bt', 'entry_ts')} WHERE ratio >= 5 AND typ = 'C' AND strike > sp",
    "best_trades_top": f"SELECT {D}, symbol, ratio, hold_candles FROM bt ORDER BY hold_candles DESC, expiry, symbol LIMIT 50",
    "find_trades": f"SELECT symbol, {D}, low_ts, high_ts, low_price, high_price, hold_candles, ratio FROM tx WHERE ratio >= 2",
    "merge_trades": f"SELECT {D}, type, start_ts, end_ts, n, max_ratio, max_symbol, max_low, max_high, hold_candles, instruments FROM te",
    "trade_summary": f"SELECT 'EVT' AS spot, {D}, coalesce(max(max_ratio) FILTER (type = 'C'), 0.0) AS best_call, coalesce(max(max_ratio) FILTER (type = 'P'), 0.0) AS best_put, {_SIDES}, '120' AS durations FROM te GROUP BY expiry",
    "trade_scan": f"SELECT 'EVT' AS spot, {D}, scanned, coalesce(raw_trades, 0) AS raw_trades, coalesce(qualifying, 0) AS qualifying FROM (SELECT expiry, count(DISTINCT symbol) AS scanned FROM bars GROUP BY expiry) LEFT JOIN (SELECT expiry, count(*) AS raw_trades, count(*) FILTER (ratio >= 5) AS qualifying FROM tx GROUP BY expiry) USING (expiry)",
    "ema_spread": f"SELECT symbol, {D}, ts, {r('x.ema', 4)} AS ema5, {r('y.ema', 4)} AS ema10, {r(r('CASE WHEN close > 0 AND x.ema IS NOT NULL AND y.ema IS NOT NULL THEN (greatest(x.ema, y.ema) - least(x.ema, y.ema)) / close * 100 END', 6), 3)} AS spread_pct FROM b LEFT JOIN e5 x USING (symbol, expiry, n) LEFT JOIN e10 y USING (symbol, expiry, n)",
    "last_ema_points": f"SELECT symbol, {D}, ts, {r('ema', 4)} AS ema5 FROM b LEFT JOIN e5 USING (symbol, expiry, n) WHERE n > size - 3",
    "price_volatility": f"SELECT symbol, {D}, ts, {r('v5', 4)} AS vol5, {r('v10', 4)} AS vol10 FROM (SELECT *, {r(f'CASE WHEN open > 0 AND close > 0 THEN ({lags(5)}) / (open * close) END', 6)} AS v5, {r(f'CASE WHEN open > 0 AND close > 0 THEN ({lags(10)}) / (open * close) END', 6)} AS v10 FROM bars)",
    "volatility_board": (
        f"SELECT symbol, {D}, ts, strike, typ AS opt_type, {r('v5', 4)} AS vol5, coalesce(CASE WHEN typ = 'C' THEN strike > sc ELSE strike < sc END, false) AS otm FROM (SELECT *, {r(f'CASE WHEN open > 0 AND close > 0 THEN ({lags(5)}) / (open * close) END', 6)} AS v5 FROM b), (SELECT arg_max(close, ts) AS sc FROM spot60) WHERE n = size AND size > 10"
    ),
    "atm_strike": (
        f"SELECT {D}, typ AS opt_type, first(symbol ORDER BY abs(strike - sc), strike, symbol) AS symbol, first(strike ORDER BY abs(strike - sc), strike, symbol) AS strike FROM b, (SELECT arg_max(close, ts) AS sc FROM spot60) WHERE n = size AND size > 10 GROUP BY expiry, typ"
    ),
    "active_durations": f"SELECT {D}, d::INT AS duration FROM (SELECT DISTINCT expiry FROM bars), (VALUES (5, 48), (10, 96), (15, 192), (20, 288), (30, 384), (40, 384), (45, 576), (60, 960), (90, 960), (120, 960), (180, 960), (240, 960), (360, 960), (480, 960), (720, 960), (1440, 960)) w(d, h) WHERE {SETTLE} >= {NOW} AND ({SETTLE} - {NOW}) / 3600.0 < h + 1",
    "work_list": (
        f"SELECT 'EVT' AS spot, {D} FROM (SELECT DISTINCT expiry FROM bars) WHERE {SETTLE} < {NOW} AND day(expiry) % 2 = 0 AND NOT day(expiry) > 10"
    ),
    "spot_upsert": "SELECT ts, close + CASE WHEN ts % 14400 = 0 THEN 1 ELSE 0 END AS close FROM spot",
    "stream_candles": f"SELECT * FROM ({candles('ticks', slot(60), 'symbol')}) WHERE ts + 3600 <= (SELECT max(t) FROM ticks) - 1800",
}


DAY = "strftime(expiry, '%Y-%m-%d')"
PRODUCT = "split_part(symbol, '-', 4)::BIGINT + 100 * day(expiry)"
CHAIN = f"(SELECT DISTINCT symbol, expiry, {PRODUCT} AS id FROM bars)"
TAUGHT = f"(SELECT *, CASE WHEN id % 2 = 0 THEN 28800 ELSE 34200 END AS s FROM {CHAIN} WHERE day(expiry) % 2 = 0)"
FIRST_WALL = "(SELECT min(expiry) FROM ev WHERE signal = 'otm_wall')"
X = "close - open"
ASKED = [(">", "ratio > 3"), (">=", "ratio >= 4"), ("<", "ratio < 2.5"), ("<=", "ratio <= 2.2"), ("between", "ratio BETWEEN 3 AND 5")]
#: The first end of the slices that streams take.
SLICE = 1_704_801_600
RECENT = f"ts >= {NOW} - 172800"

#: Round trips, filters, functions and streams.
SQL |= {
    "candle_pages": f"SELECT symbol || '@' || {DAY} AS symbol, 120 AS duration, ts, open, high, low, close, volume FROM bars",
    "compact_candles": f"SELECT 'EVT' AS spot, {D}, 120 AS duration, symbol, ts, open, high, low, close, volume FROM bars",
    "candle_table": f"SELECT symbol, {D}, ts, close, volume + CASE WHEN day(expiry) <= 7 THEN 1 ELSE 0 END AS volume FROM bars WHERE expiry <= DATE '2024-01-16'",
    "spot_table": "SELECT ts, close + CASE WHEN ts % 14400 = 0 THEN 1 ELSE 0 END AS close FROM spot WHERE ts >= epoch(DATE '2024-01-05') AND ts < epoch(DATE '2024-01-21')",
    "instrument_list": f"SELECT {D}, symbol, CASE WHEN id % 7 <> 0 AND id % 5 <> 0 THEN id ELSE -1 END AS product_id FROM {CHAIN} WHERE id % 7 <> 0 AND id % 5 <> 0 OR id % 3 = 0",
    "settlements_learned": (
        f"SELECT p.spot, strftime(p.expiry, '%Y-%m-%d') AS expiry, epoch(p.expiry)::BIGINT + coalesce(e.a, g.b, p.c) AS settle_ts FROM (SELECT DISTINCT expiry, v.spot, v.c FROM bars, (VALUES ('EVT', 43200), ('OWN', 36000), ('NEW', 43200)) v(spot, c)) p "
        f"LEFT JOIN (SELECT 'EVT' AS spot, expiry, arg_max(s, id) AS a FROM {TAUGHT} GROUP BY expiry) e ON e.spot = p.spot AND e.expiry = p.expiry LEFT JOIN (SELECT 'EVT' AS spot, arg_max(s, (epoch(expiry), id)) AS b FROM {TAUGHT}) g ON g.spot = p.spot"
    ),
    "event_table": f"SELECT signal, {D}, duration, type, start_ts, n, univ_ratio, instruments FROM ev WHERE NOT (signal = 'otm_wall' AND expiry = {FIRST_WALL})",
    "pattern_table": f"SELECT symbol, {D}, ts AS entry_ts, value AS signal_value FROM sigs WHERE signal = 'otm_wall'",
    "trade_tables": f"SELECT 'event' AS kind, {D}, max_symbol AS symbol, max_ratio AS ratio FROM te UNION ALL SELECT 'best', {D}, symbol, ratio FROM bt",
    "snapshot_table": f"SELECT symbol, {D}, ts, close + CASE WHEN day(expiry) % 2 = 0 THEN 1 ELSE 0 END AS close FROM b WHERE n > size - 2 AND {SETTLE} >= {NOW}",
    "inventory": f"SELECT DISTINCT 'EVT' AS spot, {D}, 120 AS duration FROM bars",
    "ratio_filters": " UNION ALL ".join(f"SELECT '{op}' AS op, {D}, count(*) AS n, max(ratio) AS top FROM tx WHERE ratio >= 2 AND {test} GROUP BY expiry" for op, test in ASKED),
    "settled_range": f"SELECT symbol, {D}, ratio FROM bt WHERE expiry BETWEEN DATE '2024-01-07' AND DATE '2024-01-16'",
    "recent_firings": f"SELECT signal, symbol, {D}, ts AS entry_ts FROM sigs WHERE {RECENT}",
    "live_signals": f"SELECT signal, symbol, {D}, ts AS entry_ts FROM sigs WHERE {RECENT} ORDER BY ts DESC, symbol, signal LIMIT 25",
    "symbols_pending": f"SELECT 'EVT' AS spot, {D}, symbol FROM {CHAIN} c WHERE NOT EXISTS (SELECT 1 FROM bars x WHERE x.symbol = c.symbol AND x.expiry = c.expiry AND x.close > 1 AND x.ts < epoch(DATE '2024-01-12'))",
    "expiry_completeness": f"SELECT 'EVT' AS spot, {D}, bool_and(ok) AS complete, count(*) AS symbols, count(*) FILTER (NOT ok) AS failed FROM (SELECT symbol, expiry, min(low) > 0.1 AS ok FROM bars GROUP BY ALL) GROUP BY expiry",
    "spot_required": f"SELECT {D}, count(*) AS n FROM bars WHERE day(expiry) % 2 = 0 GROUP BY expiry",
    "scalar_functions": (
        f"SELECT symbol, {D}, ts, {r('CASE WHEN x > 0 THEN log10(x) ELSE 0 END', 6)} AS log10, {r('CASE WHEN x > 0 THEN ln(x) ELSE 0 END', 6)} AS log, {r('exp(x / 100)', 6)} AS exp, {r('CASE WHEN x >= 0 THEN sqrt(x) ELSE 0 END', 6)} AS sqrt, "
        f"{r('abs(x)', 6)} AS abs, floor(x) AS floor, ceil(x) AS ceil, sign(x) AS sign, floor(x + 0.5) AS round, {r('x * x', 6)} AS pow, {r('least(x, 1)', 6)} AS min, {r('x', 6)} AS max, {r('CASE WHEN floor(x) = 0 THEN 0 ELSE open / floor(x) END', 6)} AS divide FROM (SELECT *, {X} AS x FROM bars)"
    ),
    "sql_functions": (
        f"SELECT symbol, {D}, ts, floor(CASE WHEN x > 0 THEN log10(x) ELSE 0 END * 1000 + 0.5) AS a, floor(CASE WHEN x >= 0 THEN sqrt(x) ELSE 0 END * 1000 + 0.5) AS b, floor(CASE WHEN floor(x) = 0 THEN 0 ELSE 1 / floor(x) END * 1000 + 0.5) AS c, "
        f"floor(x + 0.5) / 2 AS h, floor(close)::BIGINT % 4 = 1 AS one, floor(close)::BIGINT % 4 IN (2, 3) AS listed FROM (SELECT *, {X} AS x FROM bars)"
    ),
    "default_filters": (
        f"SELECT signal, symbol, {D}, ts AS entry_ts FROM sigs WHERE signal = 'otm_wall' AND value >= 0.5 AND {r(f'({SETTLE} - start) / 3600.0', 2)} <= 48 UNION ALL "
        f"SELECT s.signal, s.symbol, strftime(s.expiry, '%Y-%m-%d'), s.ts FROM sigs s JOIN gst g ON s.symbol = g.symbol AND s.expiry = g.expiry AND s.ts = g.ts WHERE s.signal = 'green_stairs' AND s.value >= 1 AND g.len >= 3 AND g.equal = 0"
    ),
    "stream_signals": f"SELECT signal, symbol, {D}, ts AS entry_ts, start AS pattern_start, value AS signal_value FROM sig0 WHERE signal <> 'green_stairs' OR pk IS NOT NULL",
    "stream_outcomes": f"SELECT symbol, {D}, ts AS entry_ts, {STATE} AS state, {RATIO} AS ratio, coalesce({r('pk', 3)}, 0.0) AS peak_after FROM rsq WHERE ts < {SLICE}",
    "stream_indicators": (
        f"SELECT symbol, {D}, ts, {r('ema', 4)} AS ema5, {r('CASE WHEN open > 0 AND close > 0 THEN v / (open * close) END', 4)} AS vol5 FROM (SELECT *, {lags(5)} AS v FROM b) LEFT JOIN e5 USING (symbol, expiry, n) WHERE n > size - 3"
    ),
    "stream_spot": SQL["spot_upsert"],
    "stream_enriched": f"SELECT symbol, {D}, ts, {PRODUCT} AS product_id, {SETTLE} - 86400 AS settle_ts FROM bars WHERE ts < {SETTLE} - 86400",
    "live_snapshot": (
        f"SELECT {D}, c.instruments, '120' AS durations, coalesce(g.n_signals, 0) AS n_signals, {r(f'({SETTLE} - {NOW}) / 3600.0', 1)} AS hours_to_expiry, (SELECT arg_max(close, ts) FROM spot) AS spot_price, coalesce(g.signals, '') AS signals "
        "FROM (SELECT expiry, count(DISTINCT symbol) AS instruments FROM bars GROUP BY expiry) c LEFT JOIN (SELECT expiry AS e, count(*) AS n_signals, string_agg(signal || '/' || symbol || '/' || ts, ',' ORDER BY k) FILTER (k <= 10) AS signals "
        f"FROM (SELECT *, row_number() OVER (PARTITION BY expiry ORDER BY ts DESC, symbol, signal) AS k FROM sigs WHERE {RECENT}) GROUP BY expiry) g ON g.e = c.expiry"
    ),
}


def longer(sql: str) -> str:
    """A query of the 120-minute chain, of the 240-minute chain."""
    return build(sql).replace(slot(120), slot(240)).replace("120 AS duration", "240 AS duration")


def both_durations(sql: str) -> str:
    """A query without a duration, of both chains."""
    return f"SELECT 120 AS duration, * FROM ({build(sql)}) UNION ALL SELECT 240 AS duration, * FROM ({longer(sql)})"


def over_both(sql: str) -> str:
    """A query of the events of both chains."""
    events = "SELECT * FROM ev"
    return f"WITH ev AS (SELECT * FROM ({build(events)}) UNION ALL SELECT * FROM ({longer(events)})) {sql}"


#: The same red runs over the gapless daily candles of suppliers.
SUPPLIER_BARS = (
    f"SELECT symbol, DATE '2030-01-01' AS expiry, NULL AS typ, NULL AS strike, ts, open, greatest(high, open) AS high, least(low, open) AS low, close FROM "
    f"(SELECT * REPLACE (coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY ts), open) AS open) FROM ({SQL['daily_bars_supplier']}))"
)
SUPPLIER_SQUEEZE = f"SELECT symbol, ts AS entry_ts, start AS pattern_start, len::INT AS seq_length, {r('greatest(r1, r2)', 3)} AS signal_value, {STATE} AS state, {RATIO} AS ratio FROM rsq WHERE greatest(r1, r2) >= 2"


#: Many moments, counts that come with the rows, and streams with keyed state.
_AT = "(SELECT DISTINCT ts // 43200 * 43200 AS moment FROM bars)"
_ALIVE = f"(SELECT moment, expiry, listed_ts FROM {_AT} m, (SELECT expiry, min(ts) AS listed_ts FROM bars GROUP BY expiry) WHERE listed_ts <= moment AND {SETTLE} > moment)"
_FIRED = "FROM sig0 WHERE signal <> 'green_stairs' OR pk IS NOT NULL"
_LIVE = f"(SELECT * FROM b WHERE {SETTLE} > (SELECT max(ts) FROM bars))"
SQL |= {
    "alive_expiries_at": f"SELECT moment, {D}, listed_ts FROM {_ALIVE}",
    "heatmap_at": (
        f"SELECT a.moment, {D.replace('expiry::', 'a.expiry::')}, a.slot, coalesce(fired, 0) AS fired, coalesce(names, '') AS names FROM (SELECT moment, expiry, unnest(generate_series(moment // 7200 * 7200 - 11 * 7200, moment // 7200 * 7200, 7200)) AS slot FROM {_ALIVE}) a LEFT JOIN "
        f"(SELECT moment, expiry, slot, len(l) AS fired, array_to_string(l[1:14], ',') AS names FROM (SELECT m.moment, e.expiry, e.end_ts // 7200 * 7200 AS slot, list_sort(list_distinct(flatten(list(syms)))) AS l FROM ev e, {_AT} m WHERE signal = 'otm_wall' AND type = 'C' "
        "AND end_ts <= m.moment GROUP BY ALL)) g ON g.moment = a.moment AND g.expiry = a.expiry AND g.slot = a.slot"
    ),
    "clustered_candles": SQL["peak_after"],
    "loose_equality": (
        f"SELECT symbol, {D}, ts, x = -1 AS text_one, true AS text_zero, x <> 0 AS not_abc, x = CASE WHEN close > open THEN 1 ELSE 0 END AS number_flag, x IN (0, 1) AS listed, x IN (0, 3) AS mixed, x = 0 AS sql_zero, x = 1 AS sql_text "
        "FROM (SELECT *, floor(close)::BIGINT % 4 AS x FROM bars)"
    ),
    "counted_rows": (
        "SELECT 'tagged' AS of, count(*) AS n FROM tag WHERE mb IS NOT NULL UNION ALL SELECT 'trades', count(*) FROM tx WHERE ratio >= 5 UNION ALL SELECT 'excluded', count(*) FROM tag WHERE mb IS NULL "
        "UNION ALL SELECT 'raw_trades', count(*) FROM tx UNION ALL SELECT 'qualifying', count(*) FROM tx WHERE ratio >= 5 UNION ALL SELECT 'empty ' || f, 1 FROM (VALUES ('distance_pct'), ('equal_steps'), ('dist')) x(f)"
    ),
    "stream_expiring": SQL["stream_signals"],
    "stream_pass": (
        f"SELECT signal AS kind, symbol, {D}, ts AS moment, value {_FIRED} UNION ALL SELECT 'point', symbol, {D}, ts, close FROM {_LIVE} WHERE n > size - 3 "
        f"UNION ALL SELECT 'board', count(DISTINCT symbol)::VARCHAR, {D}, max(ts), (SELECT count(*) FROM sig0 x WHERE x.expiry = y.expiry AND (x.signal <> 'green_stairs' OR x.pk IS NOT NULL))::DOUBLE FROM {_LIVE} y GROUP BY expiry"
    ),
    "stream_followed": SQL["stream_outcomes"],
    "stream_final": f"SELECT symbol, {D}, ts, close, volume FROM bars WHERE ts < (SELECT max(ts) FROM bars) - 43200",
}


def oracle_sql() -> dict[str, str]:
    found = {k: build(v, "bars" if k == "folds" else "units") for k, v in SQL.items()}
    runs = ", ".join(f"{n} AS ({TABLES[n]})" for n in ("b", "rr", "rs", "rn", "ra", "rg", "rsq"))
    hourly = f"SELECT *, DATE '2030-01-01' AS expiry, NULL AS typ, NULL AS strike FROM ({SQL['ohlcv_60m']})"
    rates = f"SELECT *, {pct(T3)} FROM (SELECT symbol, count(*) AS n, count(*) FILTER (state = 'activated') AS activated, count(*) FILTER (state = 'slHit') AS slHit, count(*) FILTER (state = 'pending') AS pending, {hits('ratio', T3)} FROM (SELECT symbol, {STATE} AS state, {RATIO} AS ratio FROM rsq) GROUP BY symbol)"
    return found | {
        "supplier_squeeze": f"WITH bars AS ({SUPPLIER_BARS}), {runs} {SUPPLIER_SQUEEZE}",
        "outcomes_multi": both_durations(f"SELECT signal, symbol, {D}, ts AS entry_ts, sp0 AS spot_price, dist_pct AS distance_pct, ratio, state, univ_ratio, univ_symbol FROM sigs"),
        "merge_events_multi": over_both(SQL["merge_events"]),
        "hit_tree_multi": over_both(SQL["hit_tree"]),
        "panels_multi": over_both(SQL["panels"]),
        "expiry_grid_multi": over_both(f"SELECT {D}, count(*) FILTER (max_ratio >= 2 AND duration = 120) AS d120, count(*) FILTER (max_ratio >= 2 AND duration = 240) AS d240, count(*) FILTER (max_ratio >= 2) AS hits, count(*) AS n FROM ev GROUP BY expiry"),
        "spot_by_duration": both_durations(f"SELECT symbol, {D}, ts, sp AS spot_close FROM {asof('bars', 'ts')}"),
        "squeeze_hit_rates": f"WITH ticks AS ({TABLES['ticks']}), bars AS ({hourly}), {runs} {rates}",
    }
