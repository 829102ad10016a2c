"""Window queries: indicators, fills, returns and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.config import DAY, HOUR, SHORT
from barloom.operators import etl, fill, indicators
from barloom.operators.ewm import ewm
from barloom.operators.features import sequence_windows
from barloom.operators.toplists import last_values
from barloom.plans.catalog import DB, HB, HOURLY_SYMBOLS, HOURLY_TARGET, THIN, Tables, panel_sql, query

_W = "PARTITION BY symbol ORDER BY ts"


def _bars(extra: str, source: str = "hb", with_sql: str = HB, before: str = "", where: str = "") -> str:
    """Bars plus computed columns; `before` adds inner columns the outer ones build on."""
    inner = f"(SELECT *, {before} FROM {source})" if before else source
    return f"WITH {with_sql} SELECT symbol, ts, open, high, low, close, volume, {extra} FROM {inner} {where}"


def _strict(fn: str, x: str, n: int, partition: str = _W) -> str:
    frame = f"OVER ({partition} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} = {n} THEN {fn}({x}) {frame} END"


def _part(fn: str, x: str, n: int) -> str:
    return f"{fn}({x}) OVER ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query("sma14", _bars(f"{_part('avg', 'close', 14)} AS sma14"), doubles="sma14")
def sma14(t: Tables) -> DataFrame:
    return indicators.sma(t.hourly(), n=14, name="sma14", step_seconds=HOUR, full=False)


@query("sma20", _bars(f"{_strict('avg', 'close', 20)} AS sma20"), doubles="sma20")
def sma20(t: Tables) -> DataFrame:
    return indicators.sma(t.hourly(), n=20, name="sma20", step_seconds=HOUR, full=True)


@query("feat_sma20", _bars(f"{_part('avg', 'close', 20)} AS sma20"), doubles="sma20")
def feat_sma20(t: Tables) -> DataFrame:
    return indicators.sma(t.hourly(), n=20, name="sma20", step_seconds=HOUR, full=False)


@query("feat_vol20", _bars(f"{_part('stddev_samp', 'close', 20)} AS rolling_vol20"), doubles="rolling_vol20")
def feat_vol20(t: Tables) -> DataFrame:
    return indicators.rolling_std(t.hourly(), n=20, name="rolling_vol20", step_seconds=HOUR)


def _ewm_sql(x: str, span: int) -> str:
    """Adjusted mean: a left fold over the values so far, over the sum of the weights."""
    d = 1 - 2 / (span + 1)
    return (
        f"list_reduce(list({x}) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda a, b: a * {d!r} + b)"
        f" * (1 - {d!r}) / (1 - pow({d!r}, count({x}) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))"
    )


def _ewm_recursive_sql(x: str, span: int) -> str:
    a = 2 / (span + 1)
    return (
        f"list_reduce(list({x}) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),"
        f" lambda a, b: a * {1 - a!r} + b * {a!r})"
    )


@query("ema14", _bars(f"{_ewm_recursive_sql('close', 14)} AS ema14"), doubles="ema14")
def ema14(t: Tables) -> DataFrame:
    return ewm(t.hourly(), "close", "ema14", span=14, adjust=False, step_seconds=HOUR, gaps=False)


@query("ema12", _bars(f"{_ewm_sql('close', 12)} AS ema_12"), doubles="ema_12")
def ema12(t: Tables) -> DataFrame:
    return ewm(t.hourly(), "close", "ema_12", span=12, step_seconds=HOUR, gaps=False)


@query("ema26", _bars(f"{_ewm_sql('close', 26)} AS ema_26", "db", DB), doubles="ema_26", digits=3)
def ema26(t: Tables) -> DataFrame:
    return ewm(t.daily(), "close", "ema_26", span=26, step_seconds=DAY, gaps=False)


_MACD_SQL = f"""WITH {HB},
e AS (SELECT *, {_ewm_sql('close', 12)} AS ema_12, {_ewm_sql('close', 26)} AS ema_26 FROM hb),
m AS (SELECT *, ema_12 - ema_26 AS macd FROM e),
s AS (SELECT *, {_ewm_sql('macd', 9)} AS macd_signal FROM m)
SELECT symbol, ts, open, high, low, close, volume, ema_12, ema_26, macd, macd_signal,
       macd - macd_signal AS macd_hist FROM s"""


@query("macd", _MACD_SQL, doubles="ema_12 ema_26 macd macd_signal macd_hist")
def macd(t: Tables) -> DataFrame:
    return indicators.macd(t.hourly(), step_seconds=HOUR)


_STEP = f"close - lag(close) OVER ({_W}) AS step"
_MOVES = f"(SELECT *, coalesce(greatest(step, 0), 0) AS up, coalesce(greatest(-step, 0), 0) AS down FROM (SELECT *, {_STEP} FROM hb))"


def _rsi_sql(mean) -> str:
    return f"(SELECT *, {mean('avg', 'up', 14)} AS gain, {mean('avg', 'down', 14)} AS loss FROM {_MOVES})"


_RSI_ETL = "100 - 100 / (1 + gain / nullif(loss, 0))"
_RSI = f"CASE WHEN loss = 0 AND gain > 0 THEN 100.0 ELSE {_RSI_ETL} END"


@query("rsi14_etl", _bars(f"{_RSI_ETL} AS rsi14", _rsi_sql(_part)), doubles="rsi14")
def rsi14_etl(t: Tables) -> DataFrame:
    return indicators.rsi(t.hourly(), name="rsi14", step_seconds=HOUR, full=False)


@query("rsi14", _bars(f"{_RSI} AS rsi", _rsi_sql(_strict)), doubles="rsi")
def rsi14(t: Tables) -> DataFrame:
    return indicators.rsi(t.hourly(), name="rsi", step_seconds=HOUR, full=True)


_BOLL = f"{_strict('avg', 'close', 20)} AS bb_middle, {_strict('stddev_samp', 'close', 20)} AS sd"


@query(
    "bollinger",
    _bars("bb_middle, bb_middle + 2 * sd AS bb_upper, bb_middle - 2 * sd AS bb_lower, (bb_middle + 2 * sd) - (bb_middle - 2 * sd) AS bb_width", before=_BOLL),
    doubles="bb_middle bb_upper bb_lower bb_width",
)
def bollinger(t: Tables) -> DataFrame:
    return indicators.bollinger(t.hourly(), step_seconds=HOUR)


def _tr(source: str = "hb") -> str:
    return f"""(SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr
      FROM (SELECT *, lag(close) OVER ({_W}) AS pc FROM {source}))"""


@query("atr14", _bars(f"{_strict('avg', 'tr', 14)} AS atr", _tr()), doubles="atr")
def atr14(t: Tables) -> DataFrame:
    return indicators.atr(t.hourly(), step_seconds=HOUR)


_STOCH_K = f"100 * (close - {_strict('min', 'low', 14)}) / nullif({_strict('max', 'high', 14)} - {_strict('min', 'low', 14)}, 0) AS stoch_k"


@query("stochastic", _bars(f"stoch_k, {_strict('avg', 'stoch_k', 3)} AS stoch_d", before=_STOCH_K), doubles="stoch_k stoch_d")
def stochastic(t: Tables) -> DataFrame:
    return indicators.stochastic(t.hourly(), step_seconds=HOUR)


@query(
    "volume_ratio",
    _bars("volume_sma, volume / nullif(volume_sma, 0) AS volume_ratio", before=f"{_strict('avg', 'volume', 20)} AS volume_sma"),
    doubles="volume_sma volume_ratio",
)
def volume_ratio(t: Tables) -> DataFrame:
    return indicators.volume_ratio(t.hourly(), step_seconds=HOUR)


def _pct(k: int, x: str = "close") -> str:
    return f"{x} / nullif(lag({x}, {k}) OVER ({_W}), 0) - 1"


@query("roc10", _bars(f"{_pct(10)} AS roc"), doubles="roc")
def roc10(t: Tables) -> DataFrame:
    return indicators.rate_of_change(t.hourly(), step_seconds=HOUR)


@query("volatility20", _bars(f"{_strict('stddev_samp', 'ret', 20)} AS volatility", before=f"{_pct(1)} AS ret"), doubles="volatility")
def volatility20(t: Tables) -> DataFrame:
    return indicators.volatility(t.hourly(), step_seconds=HOUR)


@query(
    "gold_macro",
    _bars(
        f"returns_30, {_strict('stddev_samp', 'ret', 30)} AS volatility_30",
        before=f"{_pct(1)} AS ret, {_pct(30)} AS returns_30",
        where=f"WHERE symbol = '{HOURLY_TARGET}'",
    ),
    doubles="returns_30 volatility_30",
)
def gold_macro(t: Tables) -> DataFrame:
    return indicators.target_macro(t.hourly(), target=HOURLY_TARGET, step_seconds=HOUR)


@query("prev_close_open", f"WITH {HB} SELECT symbol, ts, lag(close) OVER ({_W}) AS open, high, low, close, volume FROM hb")
def prev_close_open(t: Tables) -> DataFrame:
    return indicators.previous_close_open(t.hourly(), step_seconds=HOUR)


@query(
    "returns", _bars(f"close - lag(close) OVER ({_W}) AS diff_1, {_pct(1)} AS pct_1, {_pct(10)} AS pct_10"),
    doubles="diff_1 pct_1 pct_10",
)
def returns(t: Tables) -> DataFrame:
    return indicators.returns(t.hourly(), step_seconds=HOUR)


# --- fills ----------------------------------------------------------------------------------------------------------

_FORWARD = "last_value({x} IGNORE NULLS) OVER ({p} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_BACKWARD = "first_value({x} IGNORE NULLS) OVER ({p} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def _thin_fill(how: str) -> str:
    forward, backward = _FORWARD.format(x="close", p=_W), _BACKWARD.format(x="close", p=_W)
    value = {"forward": forward, "backward": backward, "both": f"coalesce({forward}, {backward})"}[how]
    return f"WITH {THIN} SELECT symbol, ts, {value} AS close, volume FROM thin"


@query("ffill", _thin_fill("forward"))
def ffill(t: Tables) -> DataFrame:
    b = t.thin().select("symbol", "ts", "close", "volume")
    return fill.fill_rows(b, ["close"], by=["symbol"], step_seconds=HOUR, how="forward")


@query("bfill", _thin_fill("backward"))
def bfill(t: Tables) -> DataFrame:
    b = t.thin().select("symbol", "ts", "close", "volume")
    return fill.fill_rows(b, ["close"], by=["symbol"], step_seconds=HOUR, how="backward")


_PANEL_COLS = [f"{s}_close" for s in HOURLY_SYMBOLS]
_THIN_PANEL = THIN + ", " + panel_sql("thin", "panel", HOURLY_SYMBOLS, ["close"])


@query(
    "fill_both",
    f"WITH {_THIN_PANEL} SELECT ts, "
    + ", ".join(
        f'coalesce({_FORWARD.format(x=c, p="ORDER BY ts")}, {_BACKWARD.format(x=c, p="ORDER BY ts")}) AS {c}'
        for c in _PANEL_COLS
    )
    + " FROM panel",
)
def fill_both(t: Tables) -> DataFrame:
    return fill.fill_rows(t.thin_panel(), _PANEL_COLS, step_seconds=HOUR)


def _interpolated(c: str) -> str:
    order = "ORDER BY ts"
    left, right = _FORWARD.format(x=c, p=order), _BACKWARD.format(x=c, p=order)
    at = f"CASE WHEN {c} IS NOT NULL THEN pos END"
    left_at, right_at = _FORWARD.format(x=at, p=order), _BACKWARD.format(x=at, p=order)
    inside = f"{left} + ({right} - {left}) / nullif({right_at} - {left_at}, 0) * (pos - {left_at})"
    return f"coalesce({c}, {inside}, {left}, {right}) AS {c}"


@query(
    "interpolate_linear",
    f"WITH {_THIN_PANEL}, numbered AS (SELECT *, row_number() OVER (ORDER BY ts) AS pos FROM panel) SELECT ts, "
    + ", ".join(_interpolated(c) for c in _PANEL_COLS)
    + " FROM numbered",
    doubles=" ".join(_PANEL_COLS),
)
def interpolate_linear(t: Tables) -> DataFrame:
    return fill.interpolate_rows(t.thin_panel(), _PANEL_COLS, step_seconds=HOUR)


@query(
    "atr_last",
    f"""WITH {HB}, a AS (SELECT symbol, ts, CASE WHEN count(tr) OVER f >= 2 THEN avg(tr) OVER f END AS atr
      FROM {_tr()} WINDOW f AS ({_W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
    SELECT symbol, last(atr ORDER BY ts) AS atr, max(ts) AS ts FROM a GROUP BY symbol""",
    doubles="atr",
)
def atr_last(t: Tables) -> DataFrame:
    return last_values(indicators.atr(t.hourly(), step_seconds=HOUR, at_least=2), ["atr"])


_SEQ = f"OVER ({_W} ROWS BETWEEN {SHORT.sequence_steps} PRECEDING AND 1 PRECEDING)"


@query(
    "sequence_windows",
    f"""WITH {HB}, s AS (SELECT symbol, ts, close AS y, list([close, volume]) {_SEQ} AS seq FROM hb)
    SELECT symbol, ts, y, CAST(len(seq) AS INT) AS steps, list_sum(list_transform(seq, lambda r: r[1])) AS sum_close,
           seq[1][1] AS first_close, seq[-1][2] AS last_volume FROM s WHERE len(seq) = {SHORT.sequence_steps}""",
    doubles="sum_close",
)
def sequences(t: Tables) -> DataFrame:
    out = sequence_windows(t.hourly(), ["close", "volume"], steps=SHORT.sequence_steps, step_seconds=HOUR)
    total = F.aggregate("sequence", F.lit(0.0), lambda acc, row: acc + row[0])
    return out.select(
        "symbol", "ts", F.col("close").alias("y"), F.size("sequence").alias("steps"), total.alias("sum_close"),
        F.element_at("sequence", 1)[0].alias("first_close"), F.element_at("sequence", -1)[1].alias("last_volume"),
    )


def indicator_ctes(source: str) -> str:
    """CTEs up to `c`, from which `INDICATOR_SELECT` takes all indicators of the bars in `source`."""
    return f"""a AS (SELECT *, {_ewm_sql('close', 12)} AS ema_12, {_ewm_sql('close', 26)} AS ema_26,
   {_strict('avg', 'close', 20)} AS bb_middle, {_strict('stddev_samp', 'close', 20)} AS sd,
   close - lag(close) OVER ({_W}) AS step, lag(close) OVER ({_W}) AS pc, {_STOCH_K},
   {_strict('avg', 'volume', 20)} AS volume_sma, {_pct(10)} AS roc, {_pct(1)} AS ret FROM {source}),
b AS (SELECT *, ema_12 - ema_26 AS macd, coalesce(greatest(step, 0), 0) AS up, coalesce(greatest(-step, 0), 0) AS down,
   greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM a),
c AS (SELECT *, {_ewm_sql('macd', 9)} AS macd_signal, {_strict('avg', 'up', 14)} AS gain,
   {_strict('avg', 'down', 14)} AS loss, {_strict('avg', 'tr', 14)} AS atr, {_strict('avg', 'stoch_k', 3)} AS stoch_d,
   {_strict('stddev_samp', 'ret', 20)} AS volatility FROM b)"""


INDICATOR_SELECT = f"""SELECT symbol, ts, open, high, low, close, volume, bb_middle AS sma_20, ema_12, ema_26, macd, macd_signal,
   macd - macd_signal AS macd_hist, {_RSI} AS rsi, bb_middle, bb_middle + 2 * sd AS bb_upper,
   bb_middle - 2 * sd AS bb_lower, (bb_middle + 2 * sd) - (bb_middle - 2 * sd) AS bb_width, atr, stoch_k, stoch_d, volume_sma,
   volume / nullif(volume_sma, 0) AS volume_ratio, roc, volatility FROM c"""
SET_SQL = f"WITH {HB}, {indicator_ctes('hb')} {INDICATOR_SELECT}"


@query("indicator_set", SET_SQL, doubles=" ".join(indicators.INDICATORS))
def indicator_set(t: Tables) -> DataFrame:
    return indicators.indicator_set(t.hourly(), step_seconds=HOUR)


_GAP_EWM = f"""WITH RECURSIVE {THIN},
n AS (SELECT symbol, ts, close, row_number() OVER ({_W}) AS pos FROM thin),
r AS (
  SELECT symbol, ts, close, pos, coalesce(close, 0e0) AS num, CASE WHEN close IS NULL THEN 0e0 ELSE 1e0 END AS den
  FROM n WHERE pos = 1
  UNION ALL
  SELECT n.symbol, n.ts, n.close, n.pos, r.num * {{d}} + coalesce(n.close, 0e0),
         r.den * {{d}} + CASE WHEN n.close IS NULL THEN 0e0 ELSE 1e0 END
  FROM r JOIN n ON n.symbol = r.symbol AND n.pos = r.pos + 1)
SELECT symbol, ts, close, num / nullif(den, 0) AS ema FROM r""".replace("{d}", repr(1 - 2 / 13))


@query("ema_with_gaps", _GAP_EWM, doubles="ema")
def ema_with_gaps(t: Tables) -> DataFrame:
    """A missing value keeps the mean and decays the weights of what came before."""
    b = t.thin().select("symbol", "ts", "close")
    return ewm(b, "close", "ema", span=12, step_seconds=HOUR)


# --- the batch steps before training --------------------------------------------------------------------------------

_ETL_COLS = [f"{s}_{f}" for s in HOURLY_SYMBOLS for f in etl.PANEL_FEATURES]
_ETL_KEPT = " + ".join(f"CAST({c} IS NULL AS INT)" for c in _ETL_COLS)
_ETL_SQL = f"""WITH {HB}, moves AS {_MOVES},
  base AS (SELECT *, {_part('avg', 'close', 14)} AS sma14, {_ewm_recursive_sql('close', 14)} AS ema14, {_part('avg', 'up', 14)} AS gain, {_part('avg', 'down', 14)} AS loss FROM moves),
  ind AS (SELECT symbol, ts, open, high, low, close, volume, sma14, ema14, {_RSI_ETL} AS rsi14 FROM base),
  {panel_sql('ind', 'panel', HOURLY_SYMBOLS, etl.PANEL_FEATURES)},
  kept AS (SELECT * FROM panel WHERE ts <= TIMESTAMP '2024-01-25' AND {_ETL_KEPT} <= 0.2 * {len(_ETL_COLS)})
  SELECT ts, {", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER b, first_value({c} IGNORE NULLS) OVER a) AS {c}" for c in _ETL_COLS)} FROM kept
  WINDOW b AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""


@query("etl_panel", _ETL_SQL, doubles=" ".join(_ETL_COLS))
def etl_panel(t: Tables) -> DataFrame:
    return etl.etl_panel(t.hourly(), HOURLY_SYMBOLS, SHORT, end=F.lit("2024-01-25").cast("timestamp_ntz"))


@query("feature_table", _bars(f"{_part('avg', 'close', 20)} AS sma20, {_part('stddev_samp', 'close', 20)} AS rolling_vol20"), doubles="sma20 rolling_vol20")
def feature_table(t: Tables) -> DataFrame:
    return etl.feature_table(t.hourly(), step_seconds=HOUR)


@query("validation_record", f"""WITH {HB} SELECT epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(max(ts)) <= 21600 AS freshness_ok,
  (SELECT bool_and(n > 100) FROM (SELECT count(close) AS n FROM hb GROUP BY symbol)) AS missing_rate_ok, CAST(NULL AS DOUBLE) AS last_mape FROM hb""")
def validation_record(t: Tables) -> DataFrame:
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return etl.validation_record(t.hourly(), as_of=as_of, limit_seconds=SHORT.fresh_seconds)
