"""Shared pieces of the checking SQL."""

BARS = """bars AS (
  SELECT p_brand AS asset, CAST(date_trunc('week', l_shipdate) AS DATE) AS ts,
         min((isodow(l_shipdate) - 1) * 1099511627776 + CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) % 1099511627776 / 100.0 AS open,
         max(l_extendedprice) AS high, min(l_extendedprice) AS low,
         CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / 100.0 AS close,
         sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2
)"""

W = "(PARTITION BY asset ORDER BY ts)"

RETS = """rets AS (
  SELECT *, close / nullif(lag(close) OVER (PARTITION BY asset ORDER BY ts), 0) - 1 AS ret FROM bars
)"""

INDUSTRY = """industry AS (
  SELECT p_brand AS asset, arg_min(p_type, p_partkey) AS industry FROM part GROUP BY 1
)"""

HOURLY = """hourly AS (
  SELECT event_type AS asset, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts,
    min(struct_pack(a := e.ts, b := event_id, c := value)).c AS open, max(value) AS high, min(value) AS low,
    max(struct_pack(a := e.ts, b := event_id, c := value)).c AS close, count(*) AS volume
  FROM events e GROUP BY 1, 2
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def trail(n: int, end: int = 1, by: str = "asset") -> str:
    """Window over the n rows that end `end` rows before the current one."""
    return f"(PARTITION BY {by} ORDER BY ts ROWS BETWEEN {n} PRECEDING AND {end} PRECEDING)"


def full(agg: str, x: str, w: str, n: int) -> str:
    return f"(CASE WHEN count({x}) OVER {w} >= {n} THEN {agg} OVER {w} END)"


def pct_rank(x: str, by: str) -> str:
    """Average-tie percentage rank, NULL for NULL."""
    return (
        f"(CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) "
        f"+ (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {by}) END)"
    )


def draw(piece: int, seed: int, *ids: str) -> str:
    """Uniform number `piece` (0..2) of the digest of seed and ids."""
    text = "concat_ws('|', '%d', %s)" % (seed, ", ".join(f"CAST({i} AS VARCHAR)" for i in ids))
    return f"(CAST(('0x' || substr(md5({text}), {1 + 10 * piece}, 10)) AS BIGINT) / {float(16**10)})"


def mixed_sql(name: str, x: str) -> str:
    """Columns that mix a 32-bit integer into `name`, step by step."""
    return (
        f"xor({x}, ({x}) >> 15) AS {name}_a, ({name}_a * 739982445) & 4294967295 AS {name}_b, xor({name}_b, {name}_b >> 12) AS {name}_c, "
        f"({name}_c * 695872825) & 4294967295 AS {name}_d, xor({name}_d, {name}_d >> 15) AS {name}"
    )


def base_sql(seed: int, *ids: str) -> str:
    text = "concat_ws('|', '%d', %s)" % (seed, ", ".join(f"CAST({i} AS VARCHAR)" for i in ids))
    return f"CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)"


def sharpe_sql(mean: str, std: str, ann: int = 52) -> str:
    return f"coalesce({mean} / nullif({std}, 0) * sqrt({ann}), 0)"


N = 12
SIGNALS = f"""signals AS (
  SELECT asset, ts, close, ret,
    lag(close, 1) OVER {W} / nullif(lag(close, {N + 1}) OVER {W}, 0) - 1 AS mom,
    (lag(close, 1) OVER {W} - {full('avg(close)', 'close', trail(N), N)})
      / nullif({full('stddev_samp(close)', 'close', trail(N), N)}, 0) AS z,
    {full('stddev_samp(lr)', 'lr', trail(N), N)} AS vol
  FROM (SELECT *, ln(close / lag(close) OVER {W}) AS lr FROM rets)
)"""
STRAT = """positions AS (
  SELECT 'mom:' || asset AS strategy_id, asset, ts, ret, coalesce(CAST(sign(mom) AS DOUBLE), 0) AS position FROM signals
  UNION ALL
  SELECT 'rev:' || asset, asset, ts, ret, coalesce(-greatest(-2, least(2, z)) / 2, 0) FROM signals
),
strat AS (
  SELECT *, lagged * ret AS gross, lagged * ret - turnover * 8 / 1e4 AS net FROM (
    SELECT *, coalesce(lag(position, 1) OVER s, 0) AS lagged,
      abs(coalesce(lag(position, 1) OVER s, 0) - coalesce(lag(position, 2) OVER s, 0)) AS turnover
    FROM positions WINDOW s AS (PARTITION BY strategy_id ORDER BY ts))
)"""
# z is NULL-safe above: greatest/least ignore NULL, so a NULL z must stay 0
STRAT = STRAT.replace(
    "coalesce(-greatest(-2, least(2, z)) / 2, 0)",
    "coalesce(CASE WHEN z IS NOT NULL THEN -greatest(-2, least(2, z)) / 2 END, 0)",
)
TRIALS_BASE = with_(BARS, RETS, SIGNALS, STRAT).rstrip()
BASKETS = f"""basket_signal AS (
  SELECT 'xs_momentum' AS strategy_id, asset, ts, ret, mom AS signal FROM signals
  UNION ALL SELECT 'low_vol', asset, ts, ret, -vol FROM signals
  UNION ALL SELECT 'xs_reversion', asset, ts, ret, -z FROM signals
),
basket_rank AS (SELECT *, {pct_rank('signal', 'strategy_id, ts')} AS r FROM basket_signal),
basket_pos AS (
  SELECT *, coalesce(CASE WHEN r >= 0.8 THEN 1.0 / nullif(count(*) FILTER (r >= 0.8) OVER g, 0)
                          WHEN r <= 0.2 THEN -1.0 / nullif(count(*) FILTER (r <= 0.2) OVER g, 0) END, 0) AS position
  FROM basket_rank WINDOW g AS (PARTITION BY strategy_id, ts)
)"""


def book_sql(src: str, cost: float = 8.0) -> str:
    """Portfolio returns over a filled (book, asset, bar) matrix."""
    return f"""filled AS (
  SELECT b.strategy_id, a.asset, t.ts, coalesce(p.position, 0) AS position, coalesce(p.ret, 0) AS ret
  FROM (SELECT DISTINCT strategy_id FROM {src}) b CROSS JOIN (SELECT DISTINCT asset FROM {src}) a
  CROSS JOIN (SELECT DISTINCT ts FROM {src}) t
  LEFT JOIN {src} p ON p.strategy_id = b.strategy_id AND p.asset = a.asset AND p.ts = t.ts
),
held AS (
  SELECT *, coalesce(lag(greatest(-1, least(1, position)), 1) OVER s, 0) AS now,
            coalesce(lag(greatest(-1, least(1, position)), 2) OVER s, 0) AS was
  FROM filled WINDOW s AS (PARTITION BY strategy_id, asset ORDER BY ts)
),
book AS (
  SELECT strategy_id, ts, gross_exposure, net_exposure, turnover,
    coalesce(pnl / nullif(gross_exposure, 0), 0) - coalesce(turnover * {cost} / 1e4 / nullif(gross_exposure, 0), 0) AS net
  FROM (SELECT strategy_id, ts, sum(now * ret) AS pnl, sum(abs(now)) AS gross_exposure, sum(now) AS net_exposure,
          sum(abs(now - was)) AS turnover FROM held GROUP BY 1, 2)
)"""


def metrics_sql(src: str, by: str, ann: int = 52, turnover: str = "turnover") -> str:
    """The nine headline metrics per group of a table with net and turnover."""
    turn = f"avg({turnover}) * {ann}" if turnover else "0.0"
    return f"""SELECT {by}, annualized_return, annualized_volatility, sharpe_ratio, sortino_ratio, max_drawdown,
  CASE WHEN max_drawdown < 0 THEN annualized_return / abs(max_drawdown) ELSE 0 END AS calmar_ratio,
  hit_rate, n_observations, annual_turnover
FROM (SELECT {by}, avg(net) * {ann} AS annualized_return, stddev_samp(net) * sqrt({ann}) AS annualized_volatility,
  {sharpe_sql('avg(net)', 'stddev_samp(net)', ann)} AS sharpe_ratio,
  coalesce(avg(net) / nullif(sqrt(avg(CASE WHEN net IS NOT NULL THEN power(least(net, 0), 2) END)), 0) * sqrt({ann}), 0) AS sortino_ratio,
  min(CASE WHEN net IS NOT NULL THEN equity / nullif(peak, 0) - 1 END) AS max_drawdown,
  avg(CASE WHEN net > 0 THEN 1.0 WHEN net IS NOT NULL THEN 0.0 END) AS hit_rate,
  CAST(count(net) AS DOUBLE) AS n_observations, {turn} AS annual_turnover
  FROM (SELECT *, max(equity) OVER (PARTITION BY {by} ORDER BY ts) AS peak
        FROM (SELECT *, product(1 + net) OVER (PARTITION BY {by} ORDER BY ts) AS equity FROM {src}))
  GROUP BY {by})"""


def _horner(coefs, x: str) -> str:
    out = repr(coefs[0])
    for c in coefs[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def cdf_sql(z: str) -> str:
    """Normal CDF of a plain column."""
    from ..core.normal import TAIL_DEN, TAIL_NUM

    a = f"abs({z})"
    near = f"exp(-{a} * {a} / 2) * {_horner(TAIL_NUM, a)} / {_horner(TAIL_DEN, a)}"
    chain = f"({a} + 0.65)"
    for k in (4, 3, 2, 1):
        chain = f"({a} + {k} / {chain})"
    far = f"exp(-{a} * {a} / 2) / {chain} / sqrt(2 * pi())"
    tail = f"(CASE WHEN {a} > 37 THEN 0.0 WHEN {a} < 7.07106781186547 THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END)"


def expected_max(n: int) -> float:
    """Expected maximum of n standard normals, for SQL with a fixed trial count."""
    import math
    from statistics import NormalDist

    if n <= 1:
        return 0.0
    ppf, g = NormalDist().inv_cdf, 0.5772156649015329
    return (1 - g) * ppf(1 - 1.0 / n) + g * ppf(1 - 1.0 / (n * math.e))


NUMBERED = """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY ts) - 1 AS rn,
    count(*) OVER (PARTITION BY strategy_id) AS n FROM strat WHERE net IS NOT NULL
)"""


def moments_sql(src: str = "strat", by: str = "strategy_id") -> str:
    return f"""moments AS (
  SELECT {by}, count(net) AS n,
    CASE WHEN stddev_samp(net) >= 1e-12 THEN avg(net) / stddev_samp(net) ELSE 0 END AS sr,
    coalesce(skewness(net), 0) AS skew, coalesce(kurtosis(net), 0) AS kurt
  FROM {src} WHERE net IS NOT NULL GROUP BY {by} HAVING count(net) >= 30
)"""
