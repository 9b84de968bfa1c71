"""The adapters in SQL, for the twins of the registered queries."""

CODE = "(lpad(CAST({0} AS VARCHAR), 6, '0') || CASE {0} % 3 WHEN 0 THEN '.SZ' WHEN 1 THEN '.SH' ELSE '.BJ' END)"


def code(key: str) -> str:
    return CODE.format(key)


BARS = f"""bars AS (
    SELECT {code("c_nationkey")} AS ts_code, CAST(o_orderdate AS DATE) AS trade_date,
           arg_min(p, o_orderkey) AS open_li, max(p) AS high_li, min(p) AS low_li, arg_max(p, o_orderkey) AS close_li,
           count(*) AS volume_hand, CAST(sum(p) AS BIGINT) AS amount_li
    FROM (SELECT *, CAST(floor(o_totalprice) AS INTEGER) AS p FROM orders) JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
TICKS = """ticks AS (
    SELECT event_type AS symbol, CAST(ts AS TIMESTAMP) AS time, CAST(floor(value * 100) AS BIGINT) AS price_li,
           user_id % 7 + 1 AS volume_hand, user_id % 3 AS status, event_id AS seq FROM events)"""
MINUTES = f"""{TICKS}, minutes AS (
    SELECT symbol AS ts_code, date_trunc('minute', time) AS trade_time, '1m' AS freq, arg_min(price_li, seq) AS open_li, max(price_li) AS high_li,
           min(price_li) AS low_li, arg_max(price_li, seq) AS close_li, CAST(sum(volume_hand) AS BIGINT) AS volume_hand,
           CAST(sum(price_li * volume_hand * 100) AS BIGINT) AS amount_li FROM ticks GROUP BY 1, 2)"""
FACTORS = f"""{BARS}, factors AS (
    SELECT ts_code, trade_date, 1 + (year(trade_date) - 1990) * 0.25::DOUBLE + CASE WHEN month(trade_date) % 3 = 1 THEN 0.5::DOUBLE ELSE 0 END AS adj_factor FROM bars)"""
CALENDAR = """calendar AS (
    SELECT CAST(d AS DATE) AS cal_date, isodow(d) < 6 AS is_trading
    FROM (SELECT unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS d FROM orders))"""
_SUMS = ", ".join(
    f"CAST(coalesce(sum({k}) FILTER (WHERE buy = {'true' if side == 'buy' else 'false'} AND size = '{s}'), 0) AS BIGINT) AS {side}_{s}_{k}"
    for side in ("buy", "sell")
    for s in ("sm", "md", "lg", "elg")
    for k in ("vol", "amount")
)
FLOWS = f"""flows AS (
    SELECT {code("(l_partkey % 25)")} AS ts_code, CAST(l_shipdate AS DATE) AS trade_date, {_SUMS},
           CAST(sum(CASE WHEN buy THEN vol ELSE -vol END) AS BIGINT) AS net_mf_vol, CAST(sum(CASE WHEN buy THEN amount ELSE -amount END) AS BIGINT) AS net_mf_amount
    FROM (SELECT *, CASE WHEN l_quantity <= 12 THEN 'sm' WHEN l_quantity <= 25 THEN 'md' WHEN l_quantity <= 38 THEN 'lg' ELSE 'elg' END AS size,
                 l_returnflag <> 'R' AS buy, CAST(l_quantity AS BIGINT) AS vol, CAST(floor(l_extendedprice) AS BIGINT) AS amount FROM lineitem) GROUP BY 1, 2)"""
RECORDS = f"""records AS (
    SELECT CAST(l_shipdate AS DATE) AS date, {code("l_partkey")} AS stock_code, p_name AS stock_name, s_name AS youzi_name, s_name || ' branch' AS yingye_bu,
           CASE WHEN l_returnflag = 'R' THEN 0 ELSE a END AS buy_amount, CASE WHEN l_returnflag = 'R' THEN a ELSE 0 END AS sell_amount,
           CASE WHEN l_returnflag = 'R' THEN -a ELSE a END AS net_inflow, replace(p_type, ' ', ',') AS concepts
    FROM (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) AS a FROM lineitem) JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""
QUOTES = f"""{BARS}, quotes AS (
    SELECT *, round((close_li / CAST(lag(close_li) OVER (PARTITION BY ts_code ORDER BY trade_date) AS DOUBLE) - 1) * 100, 4) AS pct_chg FROM bars)"""
NEWS = """news AS (
    SELECT doc_id AS id, source, CASE WHEN doc_id % 7 > 0 THEN CAST(doc_id % 500 AS VARCHAR) END AS external_id,
           TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * ((doc_id % 5000) * 600) AS publish_time, substring(text, 1, 60) AS title, text AS content, doc_id % 5 = 0 AS is_important
    FROM documents)"""
BUCKETS = f"""{TICKS}, stepped AS (
    SELECT *, time_bucket(INTERVAL 5 MINUTE, time) AS b, volume_hand * 100 AS v,
           lag(price_li) OVER (PARTITION BY symbol, time_bucket(INTERVAL 5 MINUTE, time) ORDER BY time, seq) AS prior FROM ticks),
    buckets AS (
    SELECT symbol, b AS bucket_start_time, CAST(coalesce(sum(v) FILTER (WHERE status = 0), 0) AS BIGINT) AS buy_volume, CAST(coalesce(sum(v) FILTER (WHERE status = 1), 0) AS BIGINT) AS sell_volume,
           CAST(coalesce(sum(v) FILTER (WHERE status NOT IN (0, 1)), 0) AS BIGINT) AS neutral_volume, CAST(0 AS BIGINT) AS big_trade_volume, CAST(0 AS BIGINT) AS big_trade_count, CAST(sum(v) AS BIGINT) AS total_volume, count(*) AS trade_count,
           coalesce(sqrt(sum(CASE WHEN prior > 0 THEN power(price_li / CAST(prior AS DOUBLE) - 1, 2) END)), 0) AS realized_vol
    FROM stepped GROUP BY 1, 2)"""


def r6(x: str, name: str | None = None) -> str:
    """A number rounded to six places, without a negative zero."""
    return f"round({x}, 6) + 0.0 AS {name or x}"


def ts(x: str, name: str | None = None) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S') AS {name or x}"


def day(x: str, name: str | None = None) -> str:
    return f"CAST({x} AS VARCHAR) AS {name or x}"
