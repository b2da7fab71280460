"""Checks for the device window features.

The oracles are written from the definition, not from our order-key trick: each
row is joined to its previous row ``p`` and to every row of the device at or
before ``p`` inside ``(p.Date - n days, p.Date]``; future max joins rows in
``(Date, Date + 21 days]``. At sf0.01 a device has 3–24 rows, so this stays small.
"""

from __future__ import annotations


from pyspark.sql import functions as F

from capforge.functions.scalar import round_doubles
from capforge.operators import windows as W
from capforge.plans.checks import device_sql, register
from capforge.plans.fixtures import device_metrics, table

_SAME = '{a}."Type" = {b}."Type" AND {a}."Application" = {b}."Application" AND {a}."IP" = {b}."IP"'


def _same(a, b):
    return _SAME.format(a=a, b=b)


def _flagship_sql(truncate: bool, rounded: bool = True, high: float = 70, target: float = 80,
                  horizon: int = 21) -> str:
    r = (lambda e: f"round({e}, 6)") if rounded else (lambda e: e)
    win = lambda n: f'j."Date" > p."Date" - INTERVAL {n} DAY'
    counts = ",\n".join(
        f'    count(*) FILTER (WHERE j."Value" > {high} AND {win(n)}) AS c{n}' for n in (3, 7, 14, 28))
    ranges = ",\n".join(
        f'    max(j."Value") FILTER (WHERE {win(n)}) - min(j."Value") FILTER (WHERE {win(n)}) AS r{n}'
        for n in (3, 7, 14, 28))
    cnt_cols = ",\n".join(
        f'  CAST(coalesce(pa.c{n}, 0) AS DOUBLE) AS "Date_Count_Value_Above_70_Last_{n}Days"' for n in (3, 7, 14, 28))
    rng_cols = ",\n".join(
        f'  {r(f"coalesce(pa.r{n}, 0)")} AS "Date_MinMax_Range_Last_{n}Days"' for n in (3, 7, 14, 28))
    return f"""
WITH dev AS ({device_sql(truncate)}),
ord AS (
  SELECT *, row_number() OVER (PARTITION BY "Type", "Application", "IP" ORDER BY "Date", event_id) AS rn
  FROM dev
),
pa AS (
  SELECT i.event_id,
    max(j."Value") FILTER (WHERE {win(1)}) AS v1,
    max(j."Value") FILTER (WHERE {win(3)}) AS v3,
    stddev_samp(j."Value") AS sd28,
    median(j."Value") AS med28,
{counts},
{ranges}
  FROM ord i
  JOIN ord p ON {_same('p', 'i')} AND p.rn = i.rn - 1
  JOIN ord j ON {_same('j', 'i')} AND j.rn <= p.rn AND {win(28)}
  GROUP BY i.event_id
),
fu AS (
  SELECT i.event_id, max(j."Value") AS fmax
  FROM ord i
  JOIN ord j ON {_same('j', 'i')} AND j."Date" > i."Date" AND j."Date" <= i."Date" + INTERVAL {horizon} DAY
  GROUP BY i.event_id
)
SELECT o."Date", {r('coalesce(o."Value", 0)')} AS "Value", o.event_id,
  o."Date" + INTERVAL 14 DAY AS "Date_Next_2Weeks", o."Date" + INTERVAL 21 DAY AS "Date_Next_3Weeks",
  o."Type", o."Application", o."IP",
  {r('coalesce(fu.fmax, 0.0)')} AS "Value_target_Max",
  CAST(coalesce(fu.fmax, 0.0) >= {target} AS INTEGER) AS "Target",
  {r('coalesce(pa.v1, 0)')} AS "Value_Last_1Day",
  {r('coalesce(pa.v3, 0)')} AS "Value_Last_3Days",
  {r('coalesce(pa.sd28, 0)')} AS "Date_Value_Last_28Days_SDev",
  {r('coalesce(pa.med28, 0)')} AS "Date_Value_Last_28Days_Median",
{cnt_cols},
{rng_cols}
FROM ord o LEFT JOIN pa ON pa.event_id = o.event_id LEFT JOIN fu ON fu.event_id = o.event_id
"""


@register("engineer_features", _flagship_sql(False))
def q_engineer_features(spark, sf_dir):
    return round_doubles(W.engineer_features(device_metrics(spark, sf_dir), tiebreak=["event_id"]))


@register("engineer_features_ties", _flagship_sql(True))
def q_engineer_features_ties(spark, sf_dir):
    """Same on day-truncated timestamps: up to 5 rows share one (device, day)."""
    return round_doubles(W.engineer_features(device_metrics(spark, sf_dir, truncate_to_day=True),
                                             tiebreak=["event_id"]))


@register("engineer_features_blocked", _flagship_sql(True))
def q_engineer_features_blocked(spark, sf_dir):
    """Same with each device cut into 7-day blocks (the plan for very large devices)."""
    return round_doubles(W.engineer_features(device_metrics(spark, sf_dir, truncate_to_day=True),
                                             tiebreak=["event_id"], block_days=7))


@register("engineer_features_params", _flagship_sql(False, high=50, target=90, horizon=14))
def q_engineer_features_params(spark, sf_dir):
    """Other thresholds and horizon (names keep ``Above_70`` like the reference; dates keep +14/+21 days)."""
    return round_doubles(W.engineer_features(device_metrics(spark, sf_dir), high=50.0, target=90.0,
                                             horizon_days=14, tiebreak=["event_id"]))


@register("engineer_features_hot", _flagship_sql(False))
def q_engineer_features_hot(spark, sf_dir):
    """Same with 10-day blocks, shorter than most frames."""
    return round_doubles(W.engineer_features(device_metrics(spark, sf_dir), tiebreak=["event_id"], block_days=10))


def _dense_sql() -> str:
    """One device with all readings, 241.0001 s apart (no two are whole days apart): SQL's own sliding frames."""
    past = lambda n: f'(ORDER BY "Date" RANGE BETWEEN INTERVAL {n} DAY PRECEDING AND CURRENT ROW)'
    own = [("Value_Last_1Day", f"max(v) OVER {past(1)}"), ("Value_Last_3Days", f"max(v) OVER {past(3)}"),
           ("Date_Value_Last_28Days_SDev", f"stddev_samp(v) OVER {past(28)}"),
           ("Date_Value_Last_28Days_Median", f"median(v) OVER {past(28)}")]
    for n in (3, 7, 14, 28):
        own += [(f"Date_Count_Value_Above_70_Last_{n}Days", f"count(*) FILTER (WHERE v > 70) OVER {past(n)}::DOUBLE"),
                (f"Date_MinMax_Range_Last_{n}Days", f"max(v) OVER {past(n)} - min(v) OVER {past(n)}")]
    shifted = ", ".join(f'round(coalesce(lag("{c}") OVER (ORDER BY "Date"), 0), 6) AS "{c}"' for c, _ in own)
    return f"""
WITH d AS (SELECT event_id, TIMESTAMP '2024-01-01' + to_microseconds(event_id * 241000100) AS "Date", value AS v FROM events),
w AS (SELECT *, max(v) OVER (ORDER BY "Date" RANGE BETWEEN INTERVAL 1 MICROSECOND FOLLOWING AND INTERVAL 21 DAY FOLLOWING) AS ahead,
      {', '.join(f'{e} AS "{c}"' for c, e in own)} FROM d)
SELECT event_id, round(coalesce(ahead, 0), 6) AS "Value_target_Max", (coalesce(ahead, 0) >= 80)::INTEGER AS "Target", {shifted} FROM w
"""


@register("engineer_features_dense", _dense_sql())
def q_engineer_features_dense(spark, sf_dir):
    """Every reading on one device, about 10 000 in 28 days."""
    at = F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, CAST(event_id AS DECIMAL(18, 6)) * 241.0001)")
    one = table(spark, sf_dir, "events").select(F.lit("all").alias("Type"), F.lit("app").alias("Application"), F.lit("1").alias("IP"),
                                               at.alias("Date"), F.col("value").alias("Value"), "event_id")
    return round_doubles(W.engineer_features(one, tiebreak=["event_id"])).select("event_id", *W.FEATURE_COLUMNS)


# --------------------------------------------------------------- single operators (rows 42–49, 61)

_DEV_COLS = 'o."Type", o."Application", o."IP", o."Date", round(o."Value", 6) AS "Value", o.event_id'


def _past_sql(exprs: list[tuple[str, str]], max_days: int, shift: bool = True) -> str:
    """``exprs``: (alias, SQL aggregate over ``j``; ``{w:n}`` marks the n-day window condition)."""
    a = "p" if shift else "i"
    join_p = f"JOIN ord p ON {_same('p', 'i')} AND p.rn = i.rn - 1" if shift else ""
    last = "p.rn" if shift else "i.rn"

    def fill(e):
        for n in (1, 3, 7, 14, 21, 28):
            e = e.replace("{w:%d}" % n, f'j."Date" > {a}."Date" - INTERVAL {n} DAY')
        return e

    aggs = ",\n    ".join(f"{fill(e)} AS {alias}" for alias, e in exprs)
    outs = ", ".join(f'round(pa.{alias}, 6) AS "{alias}"' for alias, _ in exprs)
    return f"""
WITH dev AS ({device_sql(False)}),
ord AS (SELECT *, row_number() OVER (PARTITION BY "Type", "Application", "IP" ORDER BY "Date", event_id) AS rn FROM dev),
pa AS (
  SELECT i.event_id,
    {aggs}
  FROM ord i {join_p}
  JOIN ord j ON {_same('j', 'i')} AND j.rn <= {last} AND j."Date" > {a}."Date" - INTERVAL {max_days} DAY
  GROUP BY i.event_id
)
SELECT {_DEV_COLS}, {outs}
FROM ord o LEFT JOIN pa ON pa.event_id = o.event_id
"""


def _future_sql(days: int, target: float | None) -> str:
    tgt = f', CAST(coalesce(fu.fmax, 0.0) >= {target} AS INTEGER) AS "Target"' if target is not None else ""
    return f"""
WITH dev AS ({device_sql(False)}),
fu AS (
  SELECT i.event_id, max(j."Value") AS fmax
  FROM dev i JOIN dev j ON {_same('j', 'i')} AND j."Date" > i."Date" AND j."Date" <= i."Date" + INTERVAL {days} DAY
  GROUP BY i.event_id
)
SELECT {_DEV_COLS}, round(coalesce(fu.fmax, 0.0), 6) AS "Value_target_Max"{tgt}
FROM dev o LEFT JOIN fu ON fu.event_id = o.event_id
"""


def _dev(spark, sf_dir):
    return device_metrics(spark, sf_dir)


@register("future_max", _future_sql(21, None))
def q_future_max(spark, sf_dir):
    return round_doubles(W.future_max(_dev(spark, sf_dir), tiebreak=["event_id"]))


@register("future_target", _future_sql(21, 80))
def q_future_target(spark, sf_dir):
    return round_doubles(W.future_target(_dev(spark, sf_dir), tiebreak=["event_id"]))


@register("past_max", _past_sql([("Value_Last_1Day", 'max(j."Value") FILTER (WHERE {w:1})'),
                                  ("Value_Last_3Days", 'max(j."Value") FILTER (WHERE {w:3})')], 3))
def q_past_max(spark, sf_dir):
    return round_doubles(W.past_max(_dev(spark, sf_dir), tiebreak=["event_id"]))


@register("past_std", _past_sql([("Date_Value_Last_28Days_SDev", 'stddev_samp(j."Value")')], 28))
def q_past_std(spark, sf_dir):
    return round_doubles(W.past_std(_dev(spark, sf_dir), tiebreak=["event_id"]))


@register("past_median", _past_sql([("Date_Value_Last_28Days_Median", 'median(j."Value")')], 28))
def q_past_median(spark, sf_dir):
    return round_doubles(W.past_median(_dev(spark, sf_dir), tiebreak=["event_id"]))


@register("past_count_above", _past_sql(
    [(f"Date_Count_Value_Above_70_Last_{n}Days", 'CAST(count(*) FILTER (WHERE j."Value" > 70 AND {w:%d}) AS DOUBLE)' % n)
     for n in (3, 7, 14, 28)], 28))
def q_past_count_above(spark, sf_dir):
    return round_doubles(W.past_count_above(_dev(spark, sf_dir), tiebreak=["event_id"]))


@register("past_minmax_range", _past_sql(
    [(f"Date_MinMax_Range_Last_{n}Days",
      'max(j."Value") FILTER (WHERE {w:%d}) - min(j."Value") FILTER (WHERE {w:%d})' % (n, n)) for n in (3, 7, 14, 28)],
    28))
def q_past_minmax_range(spark, sf_dir):
    return round_doubles(W.past_minmax_range(_dev(spark, sf_dir), tiebreak=["event_id"]))


@register("shift_rows", f"""
SELECT *, lag("Value", 1) OVER (PARTITION BY "Type", "Application", "IP" ORDER BY "Date", event_id) AS "Value_shift_1"
FROM ({device_sql(False)}) d
""")
def q_shift_rows(spark, sf_dir):
    return W.shift_rows(_dev(spark, sf_dir), list(W.DEVICE_KEYS), ["Date", "event_id"], "Value", 1)


@register("rolling_stat", _past_sql([("Value_Last_14Days_Max", 'max(j."Value")')], 14, shift=False))
def q_rolling_stat(spark, sf_dir):
    return round_doubles(W.rolling_stat(_dev(spark, sf_dir), col="Value", days=14, stat="max", tiebreak=["event_id"]))
