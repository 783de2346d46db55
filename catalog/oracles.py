"""SQL twins of the registered queries, written independently as plain per-station SQL."""

from __future__ import annotations

from statistics import NormalDist

ORACLES: dict[str, str] = {}


def snap(x: str, digits: int = 9) -> str:
    return f"(round_even(({x}) * 1e{digits}, 0) / 1e{digits} + 0e0)"


def rstep(x: str, s: float) -> str:
    return f"(round_even(({x}) / CAST({s} AS DOUBLE), 0) * CAST({s} AS DOUBLE) + 0e0)"


def fstep(x: str, s: float) -> str:
    return f"(floor(({x}) / CAST({s} AS DOUBLE)) * CAST({s} AS DOUBLE) + 0e0)"


def r6(x: str) -> str:
    return snap(snap(x), 6)


def strict(agg: str, x: str) -> str:
    return f"CASE WHEN count(*) = count({x}) THEN {agg}({x}) END"


def add(name: str, ctes: str, select: str) -> None:
    ORACLES[name] = (f"WITH {ctes}\n" if ctes else "") + select


MEASURES = ["Rain", "Pressure_hPa", "Temp_C", "DewPt_C", "RH", "Wind_SP_m_s"]
ALL = ", ".join(f"{r6(m)} AS {m}" for m in MEASURES)

HOURLY_READINGS = """
r AS (SELECT event_type || '-' || CAST(user_id % 2 AS VARCHAR) AS Location, ts AS Time,
  greatest(value - 100, 0e0) AS Rain, 1000 + value % 40 AS Pressure_hPa, value % 35 AS Temp_C,
  value % 35 - user_id % 10 AS DewPt_C, value % 100 AS RH, CAST(user_id % 20 AS DOUBLE) AS Wind_SP_m_s
  FROM events)"""

DAILY_READINGS = """
r AS (SELECT l_returnflag || '-' || CAST(l_suppkey % 10 AS VARCHAR) AS Location, l_shipdate AS Time,
  greatest(l_quantity - 45, 0e0) AS Rain, 990 + l_quantity AS Pressure_hPa,
  10 * sin(dayofyear(l_shipdate) / 58.1e0) + 100 * l_discount AS Temp_C,
  10 * sin(dayofyear(l_shipdate) / 58.1e0) + 100 * l_discount - l_tax * 100 AS DewPt_C,
  50 + l_quantity AS RH, CAST(l_linenumber AS DOUBLE) AS Wind_SP_m_s
  FROM lineitem)"""

CMI = f"""
cmi AS (SELECT l_returnflag || '-' || CAST(l_suppkey % 10 AS VARCHAR) AS location,
  CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS ymd_hms, {snap("avg(l_tax) * 100 - 4", 6)} AS CMI
  FROM lineitem GROUP BY 1, 2)"""

DAILY_CMI_READINGS = DAILY_READINGS.replace("r AS (", "r0 AS (") + "," + CMI + """,
r AS (SELECT r0.*, c.CMI, p.CMI AS CMI_pre FROM r0
  LEFT JOIN cmi c ON c.location = r0.Location AND date_trunc('hour', c.ymd_hms) = date_trunc('hour', r0.Time)
  LEFT JOIN cmi p ON p.location = r0.Location AND year(p.ymd_hms) = year(r0.Time) AND month(p.ymd_hms) = month(r0.Time)
    AND day(p.ymd_hms) - 7 = day(r0.Time) AND hour(p.ymd_hms) = hour(r0.Time))"""


def grid_ctes(readings: str, minutes: int, measures=MEASURES) -> str:
    us = minutes * 60_000_000
    means = ", ".join(
        "avg(CASE WHEN Rain > 0 AND Rain < 999.9 THEN Rain END) AS Rain" if m == "Rain" else f"avg({m}) AS {m}"
        for m in measures
    )
    return f"""{readings},
b AS (SELECT Location, (epoch_us(Time) + {us // 2}) // {us} AS step, {means} FROM r GROUP BY 1, 2),
bd AS (SELECT Location, min(step) AS lo, max(step) AS hi FROM b GROUP BY 1),
g AS (SELECT Location, unnest(range(lo, hi + 1)) AS step FROM bd),
s AS (SELECT g.Location, g.step, make_timestamp(g.step * {us}) AS Time, {", ".join("b." + m for m in measures)}
  FROM g LEFT JOIN b ON b.Location = g.Location AND b.step = g.step)"""


def edges(column: str, p: str = "") -> str:
    """Steps of the last and the next known value, ``{p}ps`` and ``{p}ns``, over windows ``a`` and ``z``."""
    known = f"CASE WHEN {column} IS NOT NULL THEN step END"
    return f"max({known}) OVER a AS {p}ps, min({known}) OVER z AS {p}ns"


EDGES = """a AS (PARTITION BY Location ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  z AS (PARTITION BY Location ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""


def spline_ctes(column: str, p: str = "") -> str:
    """Cubics at the known points of ``b`` into ``{p}co``: one sweep down the whole series, one back."""
    w = "WINDOW w AS (PARTITION BY Location ORDER BY k)"
    return f"""
{p}kn AS (SELECT Location, step, CAST(step AS DOUBLE) AS x, {column} AS y, row_number() OVER w AS k, count(*) OVER (PARTITION BY Location) AS n,
  lead(CAST(step AS DOUBLE)) OVER w - step AS h, (lead({column}) OVER w - {column}) / (lead(step) OVER w - step) AS sl
  FROM b WHERE {column} IS NOT NULL WINDOW w AS (PARTITION BY Location ORDER BY step)),
{p}k2 AS (SELECT *, lag(h) OVER w AS hp, lag(sl) OVER w AS sp, (lead(sl) OVER w - sl) / (lead(x, 2) OVER w - x) AS dd FROM {p}kn {w}),
{p}k3 AS (SELECT *, coalesce((lead(dd) OVER w - dd) / (lead(x, 3) OVER w - x), 0e0) AS ddd FROM {p}k2 {w}),
{p}eq AS (SELECT Location, k, CASE WHEN k = 1 THEN 0e0 ELSE hp END AS low, CASE WHEN k = n THEN 0e0 ELSE h END AS up,
  CASE WHEN k = 1 THEN -h WHEN k = n THEN -hp ELSE 2 * (hp + h) END AS diag,
  CASE WHEN k = 1 THEN h * h * ddd WHEN k = n THEN -hp * hp * coalesce(lag(ddd, 3) OVER w, 0e0) ELSE sl - sp END AS rhs
  FROM {p}k3 WHERE n > 2 {w}),
{p}fw AS (SELECT Location, k, up / diag AS c, rhs / diag AS d FROM {p}eq WHERE k = 1
  UNION ALL SELECT e.Location, e.k, up / (diag - low * f.c), (rhs - low * f.d) / (diag - low * f.c)
  FROM {p}fw f JOIN {p}eq e ON e.Location = f.Location AND e.k = f.k + 1),
{p}bw AS (SELECT Location, k, d AS m FROM {p}fw JOIN (SELECT Location, max(k) AS k FROM {p}eq GROUP BY 1) USING (Location, k)
  UNION ALL SELECT f.Location, f.k, f.d - f.c * g.m FROM {p}bw g JOIN {p}fw f ON f.Location = g.Location AND f.k = g.k - 1),
{p}mm AS (SELECT kn.*, coalesce(m, 0e0) AS m FROM {p}k2 kn LEFT JOIN {p}bw USING (Location, k)),
{p}mn AS (SELECT *, lead(m) OVER w AS mnx, lag(m) OVER w AS mp FROM {p}mm {w}),
{p}co AS (SELECT Location, step, y, 3 * m AS c2, CASE WHEN k < n THEN sl - h * (mnx + 2 * m) ELSE sp + hp * (mp + 2 * m) END AS c1,
  CASE WHEN k < n THEN (mnx - m) / h ELSE (m - mp) / hp END AS c3 FROM {p}mn)"""


def cubic(known: str, step: str, at: str) -> str:
    t = f"CAST({step} - {at}.step AS DOUBLE)"
    return f"coalesce({known}, {at}.y + {t} * ({at}.c1 + {t} * ({at}.c2 + {t} * {at}.c3)))"


def smooth_ctes(readings: str, minutes: int, measures=MEASURES, fill: str = "linear") -> str:
    """With ``fill='spline'`` the statement needs WITH RECURSIVE."""
    ends = f"""
k AS (SELECT *, {edges("Pressure_hPa")} FROM s WINDOW {EDGES}),"""
    if fill == "linear":
        filled = """
f AS (SELECT k.*, coalesce(k.Pressure_hPa, p.Pressure_hPa + (n.Pressure_hPa - p.Pressure_hPa)
    * CAST(k.step - k.ps AS DOUBLE) / CAST(k.ns - k.ps AS DOUBLE)) AS pressure_spl
  FROM k LEFT JOIN b p ON p.Location = k.Location AND p.step = k.ps
         LEFT JOIN b n ON n.Location = k.Location AND n.step = k.ns),"""
    else:
        filled = spline_ctes("Pressure_hPa") + f""",
f AS (SELECT k.*, {cubic("k.Pressure_hPa", "k.step", "co")} AS pressure_spl
  FROM k LEFT JOIN co ON co.Location = k.Location AND co.step = coalesce(k.ps, k.ns)),"""
    return grid_ctes(readings, minutes, measures) + "," + ends + filled + f"""
m AS (SELECT *, CASE WHEN count(pressure_spl) OVER w = 24 THEN avg(pressure_spl) OVER w END AS pressure_av FROM f
  WINDOW w AS (PARTITION BY Location ORDER BY step ROWS BETWEEN 11 PRECEDING AND 12 FOLLOWING)),
c AS (SELECT *, {snap("pressure_av - lag(pressure_av, 24) OVER (PARTITION BY Location ORDER BY step)")} AS pressure_chng_av
  FROM m)"""


def rain_ctes(src: str, rule: str = "A") -> str:
    """Rain flags over the CTE ``src``; result in ``fl``."""
    if rule == "A":
        starts = "lag(behind) OVER o = 0 AND rain0 > 0"
        dries = "lag(ahead) OVER o > 0 AND ahead = 0 AND rain0 = 0"
    else:
        starts = "behind - rain0 = 0 AND rain0 > 0"
        dries = "lag(ahead - rain0) OVER o = 0 AND lag(rain0) OVER o > 0"
    return f"""
rn AS (SELECT *, coalesce(Rain, 0e0) AS rain0 FROM {src}),
rs AS (SELECT *,
  CASE WHEN count(*) OVER a = 5 THEN sum(rain0) OVER a ELSE 0e0 END AS ahead,
  CASE WHEN count(*) OVER z = 5 THEN sum(rain0) OVER z ELSE 0e0 END AS behind FROM rn
  WINDOW a AS (PARTITION BY Location ORDER BY step ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING),
         z AS (PARTITION BY Location ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
fl AS (SELECT *, CASE WHEN {starts} THEN 1 ELSE 0 END AS StR, CASE WHEN {dries} THEN 1 ELSE 0 END AS StD
  FROM rs WINDOW o AS (PARTITION BY Location ORDER BY step))"""


LABELS = """
pf AS (SELECT *, CASE WHEN pressure_chng_av * lag(pressure_chng_av) OVER o <= 0
    AND lag(pressure_chng_av) OVER o <> 0 THEN 1 ELSE 0 END AS pst FROM fl
  WINDOW o AS (PARTITION BY Location ORDER BY step)),
l AS (SELECT * REPLACE (rain0 AS Rain), CAST(sum(StR + StD) OVER o AS BIGINT) AS Evt_lab,
  CAST(sum(pst) OVER o AS BIGINT) AS Press_Evt_lab, year(Time) AS Yr, month(Time) AS Mon FROM pf
  WINDOW o AS (PARTITION BY Location ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def lags_cte() -> str:
    return """
lg AS (SELECT Location, lag(Time) OVER (PARTITION BY Location ORDER BY Time) AS St, Time AS "End" FROM r),
lm AS (SELECT *, (epoch_us("End") - epoch_us(St)) / 6e7 AS TimeLag_min, year("End") AS Years FROM lg)"""


def gaps_cte(gap_min: float, recurrent=None) -> str:
    rec = ""
    if recurrent:
        lo, hi, n = recurrent
        rec = f""" OR (TimeLag_min > {lo} AND TimeLag_min < {hi} AND (Location, TimeLag_min) IN
          (SELECT (Location, TimeLag_min) FROM lm WHERE TimeLag_min > {lo} AND TimeLag_min < {hi}
           GROUP BY Location, TimeLag_min HAVING count(*) > {n}))"""
    return lags_cte() + f""",
gp AS (SELECT * FROM lm WHERE TimeLag_min >= {gap_min}{rec})"""


def event_ctes(src: str, p: str, pooled: bool = False) -> str:
    """Pressure events of the labelled CTE ``src`` into ``{p}e``."""
    keys = "Yr, Mon" if pooled else "Location, Yr, Mon"
    return f"""
{p}x AS (SELECT Location, max(Press_Evt_lab) AS mx FROM {src} GROUP BY 1),
{p}m AS (SELECT {keys}, {snap("avg(Temp_C)")} AS MonT FROM {src} GROUP BY {keys}),
{p}a AS (SELECT Location, Press_Evt_lab, min(Time) AS St, max(Time) AS "End",
  CAST(max(step) - min(step) + 1 AS DOUBLE) AS Dur,
  {snap(strict("sum", "pressure_chng_av"))} AS Sum_Press_Delta,
  count(*) - count(Pressure_hPa) AS Press_NA, count(*) - count(Temp_C) AS Temp_NA,
  {snap("sum(Rain)")} AS Sum_Precip, CAST(sum(StR) AS BIGINT) AS St_Rain, CAST(sum(StD) AS BIGINT) AS St_Dry
  FROM {src} GROUP BY 1, 2),
{p}d AS (SELECT {p}a.*, year(St) AS Yr, month(St) AS Mon FROM {p}a JOIN {p}x USING (Location)
  WHERE Press_Evt_lab > 0 AND Press_Evt_lab < mx AND Dur < 1000),
{p}e AS (SELECT {p}d.*, {p}m.MonT, lag(Dur) OVER o AS Dur_lag1, lag(Sum_Press_Delta) OVER o AS Press_Delta_lag1
  FROM {p}d LEFT JOIN {p}m USING ({keys}) WINDOW o AS (PARTITION BY Location ORDER BY St))"""


def full_ctes(readings: str, minutes: int, gap_min: float, recurrent=None, measures=MEASURES, fill: str = "linear") -> str:
    """Everything: series ``l``, gaps ``gp``, events ``e1e`` before and ``e2e`` after gap removal, series ``l3``."""
    return ",".join(
        [
            smooth_ctes(readings, minutes, measures, fill),
            rain_ctes("c"),
            LABELS,
            gaps_cte(gap_min, recurrent),
            event_ctes("l", "e1"),
            """
ov AS (SELECT DISTINCT e.Location, e.Press_Evt_lab FROM e1d e JOIN gp ON gp.Location = e.Location
  AND gp.St <= e."End" AND gp."End" >= e.St),
l2 AS (SELECT l.* FROM l ANTI JOIN ov USING (Location, Press_Evt_lab)),
l2x AS (SELECT Location, max(Press_Evt_lab) AS mx FROM l2 GROUP BY 1),
l3 AS (SELECT l2.* FROM l2 JOIN l2x USING (Location) WHERE Press_Evt_lab < mx)""",
            event_ctes("l3", "e2"),
        ]
    )


H_GRID = grid_ctes(HOURLY_READINGS, 60)
D_GRID = grid_ctes(DAILY_READINGS, 1440)
H_SMOOTH = smooth_ctes(HOURLY_READINGS, 60)
D_SMOOTH = smooth_ctes(DAILY_READINGS, 1440)
H = full_ctes(HOURLY_READINGS, 60, 240, (60, 240, 100))
H_SPLINE = full_ctes(HOURLY_READINGS, 60, 240, (60, 240, 100), fill="spline")
D = full_ctes(DAILY_READINGS, 1440, 5760)
DC = full_ctes(DAILY_CMI_READINGS, 1440, 5760, measures=[*MEASURES, "CMI", "CMI_pre"])

EVENT_COLS = ", ".join(
    ["Location", "Yr", "Mon", "Press_Evt_lab", "St", '"End"', "Press_NA", "Temp_NA", "St_Rain", "St_Dry"]
    + [f"{r6(c)} AS {c}" for c in ("Dur", "Sum_Press_Delta", "Sum_Precip", "MonT", "Dur_lag1", "Press_Delta_lag1")]
)

# -- sources --------------------------------------------------------------------------------

add("scan_station_csv", HOURLY_READINGS, f"SELECT date_trunc('second', Time) AS Time, Location, {ALL} FROM r")

add(
    "scan_isd_text",
    "",
    """SELECT ['BOS', 'PHL', 'PHL', 'NYC', 'NYC'][CAST(user_id % 5 AS INT) + 1] AS Location,
  date_trunc('minute', ts) AS Time,
  CASE WHEN event_id % 3 <> 0 AND event_id % 8 NOT IN (2, 3, 6, 7) THEN floor((value % 9) * 10) / 10 END AS Rain,
  CASE WHEN event_id % 13 <> 0 THEN floor((value % 40 + 1000) * 10) / 10 END AS Pressure_hPa,
  CASE WHEN event_id % 17 <> 0 THEN floor((value % 35) * 10) / 10 END AS Temp_C,
  CASE WHEN event_id % 19 <> 0 THEN floor((value % 20) * 10) / 10 END AS DewPt_C,
  CASE WHEN event_id % 11 <> 0 THEN floor((value % 100) * 10) / 10 END AS RH,
  CAST(NULL AS DOUBLE) AS Wind_SP_m_s FROM events""",
)

CMI_LINES = """
o AS (SELECT *, CAST(year(o_orderdate) AS BIGINT) AS y, (dayofyear(o_orderdate) - 1) % 54 AS w,
  CASE WHEN year(o_orderdate) < 1997 THEN 1 ELSE 2 END AS layout,
  CASE WHEN o_custkey % 9 = 0 THEN '440' ELSE '80' || CAST(o_custkey % 7 + 1 AS VARCHAR) END AS dist,
  CASE WHEN year(o_orderdate) < 1997 THEN substr(CAST(year(o_orderdate) AS VARCHAR), 3, 2)
    ELSE CAST(year(o_orderdate) AS VARCHAR) END AS yy,
  printf('%.2f', (o_orderkey % 800 - 400) / 100e0) AS cmi FROM orders)"""

add(
    "scan_cmi_text",
    CMI_LINES,
    """SELECT layout, ' ' || dist || yy || CASE WHEN w < 10 THEN ' ' || CAST(w AS VARCHAR) || ' 1.10 0.2'
   ELSE CAST(w AS VARCHAR) || ' 0.10 7' END
   || '.  3.10 0.20 ' || cmi || ' 0.80 0.90 2.00 ' AS value FROM o""",
)
add(
    "cmi_parse",
    CMI_LINES + """,
j AS (SELECT *, make_date(y, 1, 1) AS j1 FROM o WHERE dist <> '440' AND w <= 52),
f AS (SELECT *, j1 + CAST((8 - isodow(j1)) % 7 AS INT) AS first FROM j)""",
    """SELECT CASE dist WHEN '801' THEN 'PENSACOLA REGIONAL AIRPORT, FL US' WHEN '802' THEN 'TALLAHASSEE REGIONAL AIRPORT, FL US'
  WHEN '803' THEN 'JACKSONVILLE INTERNATIONAL AIRPORT, FL US' WHEN '804' THEN 'ORLANDO INTERNATIONAL AIRPORT'
  WHEN '805' THEN 'TAMPA INTERNATIONAL AIRPORT, FL US' WHEN '806' THEN 'MIAMI INTERNATIONAL AIRPORT, FL US'
  ELSE 'Key West' END AS location, cmi AS CMI,
  strftime(CASE WHEN w = 0 AND first = j1 THEN j1 ELSE first + CAST((w - 1) * 7 AS INT) END, '%Y-%m-%d 00:00:00') AS ymd_hms FROM f""",
)
add(
    "scan_cmi_csv",
    "",
    f"SELECT location, CAST(CMI AS DOUBLE) AS CMI, CAST(ymd_hms AS TIMESTAMP) AS ymd_hms FROM ({ORACLES['cmi_parse']})",
)
add(
    "isd_rejects",
    "",
    """SELECT ['725090', '999999', '724080', '999999', '725030'][CAST(user_id % 5 AS INT) + 1] AS USAF,
  ['14739', '13739', '13739', '14732', '14732'][CAST(user_id % 5 AS INT) + 1] AS NCDC,
  strftime(ts, '%Y%m') AS "Date", strftime(ts, '%H%M') AS HrMn FROM events WHERE event_id % 29 = 0""",
)
add(
    "pce_curated_events",
    "RECURSIVE " + H_SPLINE,
    f"SELECT {EVENT_COLS} FROM e2e",
)
add("sink_csv", H, f'SELECT Location, Press_Evt_lab, St, "End", {r6("Dur")} AS Dur, {r6("Sum_Press_Delta")} AS Sum_Press_Delta FROM e2e')
add(
    "dim_lookup",
    "",
    """SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey""",
)
add(
    "grid_sequence",
    "",
    """SELECT l_returnflag, CAST(unnest(range(CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE) + 1, INTERVAL 1 DAY)) AS DATE) AS day
  FROM lineitem GROUP BY 1""",
)
add(
    "prediction_grid",
    """e AS (SELECT l_returnflag, min(l_quantity) AS qa, max(l_quantity) AS qb, min(l_discount) AS da, max(l_discount) AS db
  FROM lineitem GROUP BY 1),
x AS (SELECT *, unnest(range(0, CAST(floor((qb - qa) / 0.5e0 + 1e-9) AS BIGINT) + 1)) AS i FROM e),
y AS (SELECT *, unnest(range(0, CAST(floor((db - da) / 0.01e0 + 1e-9) AS BIGINT) + 1)) AS j FROM x)""",
    f"SELECT l_returnflag, {r6('i * 0.5e0 + qa')} AS x, {r6('j * 0.01e0 + da')} AS y FROM y",
)

# -- projections, filters, bins ----------------------------------------------------------------

add(
    "project_rename",
    HOURLY_READINGS,
    f'SELECT Location, Time AS "End", {r6("Rain")} AS Precip_mm, {r6("Pressure_hPa")} AS Pressure_hPa FROM r',
)
add(
    "project_derive",
    HOURLY_READINGS,
    f"""SELECT Location, Time, {r6("Temp_C")} AS Temp_C, {r6("DewPt_C")} AS DewPt_C, year(Time) AS Yr, month(Time) AS Mon,
  (dayofyear(Time) - 1) // 7 + 1 AS Wk, day(Time) AS Day, hour(Time) AS h, {r6("Temp_C - DewPt_C")} AS diff,
  CASE WHEN Temp_C - DewPt_C > 5 THEN 1 ELSE 0 END AS warm FROM r""",
)
add(
    "project_drop_suffix",
    "",
    "SELECT l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_shipdate FROM lineitem",
)
add("unite_time", "", "SELECT event_id, date_trunc('minute', ts) AS Time FROM events")
add("fill_null", H_GRID, f"SELECT Location, Time, {r6('coalesce(Temp_C, 0e0)')} AS Rain0 FROM s")
add(
    "clean_sentinel",
    "",
    f"""SELECT l_orderkey, l_linenumber, {r6("l_extendedprice % 1000")} AS Temp,
  CASE WHEN l_extendedprice / 20 - 100 > 0 AND l_extendedprice / 20 - 100 < 999.9e0
    THEN {r6("l_extendedprice / 20 - 100")} END AS Rain
  FROM lineitem WHERE l_extendedprice % 1000 <= 900""",
)
add(
    "clean_quality_flag",
    "",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' AND l_linenumber NOT IN (2, 3, 6, 7)
  THEN l_quantity END AS Precip_Amt1 FROM lineitem""",
)
add(
    "filter_time_range",
    HOURLY_READINGS,
    f"""SELECT Location, Time, {ALL} FROM r WHERE Location = 'click-1'
  AND Time BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-20 15:00:00'""",
)
add(
    "filter_prefix",
    CMI_LINES,
    """SELECT dist || yy || CASE WHEN w < 10 THEN '0' ELSE '' END || CAST(w AS VARCHAR) AS id, cmi AS CMI
  FROM o WHERE dist <> '440'""",
)
add(
    "filter_magnitude",
    D,
    f"""SELECT Location, Press_Evt_lab, {r6("Sum_Press_Delta")} AS Sum_Press_Delta, {r6("MonT")} AS MonT, {r6("Dur")} AS Dur FROM e2e
  WHERE abs(Sum_Press_Delta) > 5.5 AND NOT (MonT > 20 AND Mon < 2) AND (MonT >= 1 OR MonT <= -1)
  AND (ln(Dur) > 0.5 OR Sum_Precip <= 0)""",
)
add(
    "filter_event_quality",
    D,
    f"""SELECT Location, Press_Evt_lab, Press_NA, {r6("Sum_Press_Delta")} AS Sum_Press_Delta, {r6("Sum_Precip")} AS Sum_Precip
  FROM e2e WHERE Press_NA < 7 AND Sum_Press_Delta > -2000 AND Sum_Press_Delta < 2000 AND Sum_Precip > 0.01""",
)
HALF = "CASE WHEN Mon < 7 THEN 'Jan ~ Jun' ELSE 'Jul ~ Dec' END"
KIND = "CASE WHEN Sum_Press_Delta < 0 THEN 'DePCE' WHEN Sum_Press_Delta IS NOT NULL THEN 'InPCE' END"
SEASON = """CASE WHEN Mon BETWEEN 3 AND 5 THEN 'Spring (MAM)' WHEN Mon BETWEEN 6 AND 8 THEN 'Summer (JJA)'
  WHEN Mon BETWEEN 9 AND 11 THEN 'Fall (SON)' ELSE 'Winter (DJF)' END"""
WET = "CASE WHEN Mon BETWEEN 6 AND 10 THEN 'wet' ELSE 'dry' END"


def band(x: str, m: int) -> str:
    return f"""CASE WHEN {x} > -2000 AND {x} <= -{m} THEN '-2000 hPa ~ -{m} hPa' WHEN {x} > -{m} AND {x} <= 0 THEN '-{m} hPa ~ 0 hPa'
  WHEN {x} > 0 AND {x} <= {m} THEN '0 hPa ~ {m} hPa' WHEN {x} > {m} AND {x} <= 2000 THEN '{m} hPa ~ 2000 hPa' END"""


add(
    "label_half_year",
    D,
    f"""SELECT Location, Press_Evt_lab, {HALF} AS YrSide, {WET} AS season,
  CASE WHEN Mon BETWEEN 4 AND 10 THEN 'wet' ELSE 'dry' END AS long_season, {KIND} AS PCEType FROM e2e""",
)
add(
    "bin_cut",
    D,
    f"""SELECT Location, Press_Evt_lab, {SEASON} AS Season, {band("Sum_Press_Delta", 300)} AS band_300,
  {band("Sum_Press_Delta", 500)} AS band_500 FROM e2e""",
)
add(
    "bin_round",
    D,
    f"""SELECT Location, Press_Evt_lab, {rstep("Sum_Press_Delta", 20)} AS epc20, {rstep("Sum_Press_Delta", 80)} AS epc80,
  {r6(rstep("MonT", 0.2))} AS amt02, {rstep("MonT", 1)} AS amt1 FROM e2e""",
)
add(
    "bin_floor",
    D,
    f"""SELECT Location, Press_Evt_lab, {fstep("Sum_Press_Delta", 30)} AS epc30, {fstep("MonT", 1)} AS amt1,
  CASE WHEN Sum_Precip > 0 THEN {fstep("ln(CASE WHEN Sum_Precip > 0 THEN Sum_Precip END)", 0.5)} END AS log_pd FROM e2e""",
)
add("distinct_rows", DAILY_READINGS, "SELECT DISTINCT Location, year(Time) AS Yr FROM r")


def sample(src: str, max_na: int | None, season: str = SEASON, name: str = "sm") -> str:
    na = f" AND Press_NA < {max_na}" if max_na is not None else ""
    return f"""
{name} AS (SELECT {fstep("MonT", 1)} AS MonT, {fstep("Sum_Press_Delta", 30)} AS Sum_Press_Delta, {season} AS Season, Sum_Precip
  FROM {src} WHERE Sum_Precip > 0{na})"""


FAN = """
fo AS (SELECT MonT + i AS MonT, Sum_Press_Delta + j AS Sum_Press_Delta, Season, Sum_Precip FROM sm,
  (VALUES (-1e0), (0e0), (1e0)) a(i), (VALUES (-30e0), (0e0), (30e0)) b(j))"""

add(
    "season_overlay",
    D + "," + sample("e2e", None),
    f"""SELECT MonT, Sum_Press_Delta, Season, {r6('Sum_Precip')} AS Sum_Precip FROM sm UNION ALL
  SELECT MonT, Sum_Press_Delta, 'All Season', {r6('Sum_Precip')} FROM sm""",
)

# -- joins ------------------------------------------------------------------------------------------

add("join_event_amt", D, f"SELECT Location, Press_Evt_lab, Yr, Mon, {r6('MonT')} AS MonT FROM e1e")
add(
    "gap_frequent",
    DAILY_READINGS + "," + lags_cte(),
    """SELECT Location, St, "End", TimeLag_min FROM (SELECT *, count(*) OVER (PARTITION BY Location, TimeLag_min) AS n
  FROM lm WHERE TimeLag_min > 1440 AND TimeLag_min < 5760) WHERE n > 100""",
)
add(
    "interval_overlap_join",
    H,
    f"""SELECT e.Location, gp.St AS "gap_St", gp."End" AS "gap_End", {r6("TimeLag_min")} AS TimeLag_min, e.Press_Evt_lab, e.St, e."End"
  FROM e1d e JOIN gp ON gp.Location = e.Location AND gp.St <= e."End" AND gp."End" >= e.St""",
)
add(
    "anti_join_gaps",
    H,
    f"SELECT Location, Time, Press_Evt_lab, Evt_lab, {r6('Rain')} AS Rain, {r6('pressure_chng_av')} AS pressure_chng_av FROM l3",
)
add("join_cmi", DAILY_CMI_READINGS, f"SELECT Location, Time, {r6('Temp_C')} AS Temp_C, CMI FROM r")
add(
    "join_cmi_shift",
    DAILY_CMI_READINGS,
    f"""SELECT r.Location, Time, {r6("RH")} AS RH, CMI_pre, q.CMI AS CMI_before FROM r
  LEFT JOIN cmi q ON q.location = r.Location AND q.ymd_hms + INTERVAL 7 DAY = date_trunc('hour', r.Time)""",
)
add("regularise_series", H_GRID, f"SELECT Location, Time, {ALL} FROM s")
add(
    "union_sources",
    HOURLY_READINGS.replace("\nr AS", "\nrh AS") + "," + DAILY_READINGS.replace("\nr AS", "\nrd AS"),
    f"""SELECT Location, Time, {ALL.replace(r6("Wind_SP_m_s"), "CAST(NULL AS DOUBLE)")} FROM rh UNION ALL
  SELECT Location, Time, {ALL.replace(r6("RH"), "CAST(NULL AS DOUBLE)")} FROM rd""",
)

# -- aggregates ----------------------------------------------------------------------------------------

add(
    "hourly_bucket_mean",
    H_GRID,
    f"SELECT Location, make_timestamp(step * 3600000000) AS Time, {ALL} FROM b",
)
add(
    "gap_table",
    HOURLY_READINGS + "," + gaps_cte(240, (60, 240, 3)),
    f'SELECT Location, St, "End", {r6("TimeLag_min")} AS TimeLag_min, Years FROM gp',
)


def spells(name: str, last: str, cond: str) -> str:
    return f"""
lx AS (SELECT Location, max(Evt_lab) AS mx FROM l GROUP BY 1),
sp AS (SELECT Location, Evt_lab, min(Time) AS Start, max(Time) AS "End", round_even(sum(Rain) * 1000e0, 0) / 1000e0 AS TotalRain,
  max(Rain) AS Max_Intensity, CAST(max(step) - min(step) + 1 AS DOUBLE) AS Dur_hr FROM l GROUP BY 1, 2),
sq AS (SELECT sp.*, lag(Dur_hr) OVER (PARTITION BY Location ORDER BY Evt_lab) AS {name} FROM sp JOIN lx USING (Location)
  WHERE Evt_lab > 0{last}),
sr AS (SELECT Location, Evt_lab, Start, "End", TotalRain, {r6("Max_Intensity")} AS Max_Intensity, Dur_hr, {name} FROM sq WHERE TotalRain {cond})"""


H_LAB = ",".join([H_SMOOTH, rain_ctes("c"), LABELS])
D_LAB = ",".join([D_SMOOTH, rain_ctes("c"), LABELS])
add("rain_events", H_LAB + "," + spells("PreDry_Dur_hr", " AND Evt_lab < mx", "> 0"), "SELECT * FROM sr")
add("dry_events", H_LAB + "," + spells("PreRain_Dur_hr", "", "= 0"), "SELECT * FROM sr")
add(
    "sink_events",
    H_LAB + "," + spells("PreDry_Dur_hr", " AND Evt_lab < mx", "> 0"),
    'SELECT Location, Evt_lab, Start, "End", TotalRain FROM sr',
)


add(
    "monthly_temp",
    HOURLY_READINGS.replace("\nr AS", "\nrh AS") + "," + DAILY_READINGS.replace("\nr AS", "\nrd AS") + f""",
bb AS (SELECT Location, (epoch_us(Time) + 1800000000) // 3600000000 * 3600000000 AS us, avg(Temp_C) AS Temp_C FROM rh GROUP BY 1, 2
  UNION ALL SELECT Location, (epoch_us(Time) + 43200000000) // 86400000000 * 86400000000, avg(Temp_C) FROM rd GROUP BY 1, 2),
tt AS (SELECT Location, make_timestamp(us) AS Time, Temp_C FROM bb)""",
    f"""SELECT Location, year(Time) AS Yr, month(Time) AS Mon, {r6(snap("avg(Temp_C)"))} AS MonT FROM tt GROUP BY 1, 2, 3
  UNION ALL SELECT 'all', year(Time), month(Time), {r6(snap("avg(Temp_C)"))} FROM tt GROUP BY 2, 3""",
)
add("pressure_events", H, f"SELECT {EVENT_COLS} FROM e1e")
add("pressure_events_gap_free", H, f"SELECT {EVENT_COLS} FROM e2e")
add(
    "event_lags",
    D,
    f"SELECT Location, Press_Evt_lab, St, {r6('Dur_lag1')} AS Dur_lag1, {r6('Press_Delta_lag1')} AS Press_Delta_lag1 FROM e2e",
)
add(
    "event_lags_pooled",
    H,
    f"""SELECT Location, Press_Evt_lab, St, {r6("lag(Dur) OVER o")} AS Dur_lag1, {r6("lag(Sum_Press_Delta) OVER o")} AS Press_Delta_lag1
  FROM e1d WINDOW o AS (ORDER BY St, Press_Evt_lab, Location)""",
)
RAIN_SHARE = "sum(CASE WHEN St_Rain > 0 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE)"
POP = r6(RAIN_SHARE)
add(
    "pop_by_epc",
    D,
    f'SELECT {rstep("Sum_Press_Delta", 20)} AS Evt_Press_chng, {POP} AS RainProb, count(*) AS samplesize FROM e2e GROUP BY 1',
)
add(
    "pop_by_epc_hourly",
    H,
    f'SELECT {rstep("Sum_Press_Delta", 80)} AS Evt_Press_chng, {POP} AS RainProb, count(*) AS samplesize FROM e1e GROUP BY 1',
)
HALF2 = "CASE WHEN Mon < 7 THEN 'Jan~Jun' ELSE 'Jul~Dec' END"
add(
    "pce_frequency",
    D,
    f"SELECT Mon AS PCE_mon, {r6('MonT')} AS MonT, count(*) AS n, {HALF2} AS HlfYr FROM e2e WHERE abs(Sum_Press_Delta) > 10 GROUP BY Mon, e2e.MonT",
)
add(
    "pce_frequency_by_station",
    H,
    f"SELECT Mon AS PCE_mon, {r6('MonT')} AS MonT, Location, count(*) AS n, {HALF2} AS HlfYr FROM e1e WHERE abs(Sum_Press_Delta) > 90 GROUP BY Mon, e1e.MonT, Location",
)
AMT02 = r6(rstep("MonT", 0.2))
add(
    "pop_by_amt",
    D,
    f"""SELECT {AMT02} AS MonT, {HALF} AS YrSide, {KIND} AS PCEType, {POP} AS RainProb, 'both' AS kind FROM e2e GROUP BY 1, 2, 3
  UNION ALL SELECT {AMT02}, {HALF}, NULL, {POP}, 'de' FROM e2e WHERE Sum_Press_Delta < 0 GROUP BY 1, 2
  UNION ALL SELECT {AMT02}, {HALF}, NULL, {POP}, 'in' FROM e2e WHERE Sum_Press_Delta > 0 GROUP BY 1, 2""",
)
add(
    "pop_surface",
    D,
    f"SELECT {rstep('Sum_Press_Delta', 1)} AS Sum_Press_Delta, {AMT02} AS MonT, {HALF} AS YrSide, {POP} AS RainProb FROM e2e GROUP BY 1, 2, 3",
)
add(
    "pop_surface_tiles",
    D,
    f"""SELECT {rstep('Sum_Press_Delta', 20)} AS Sum_Press_Delta, {rstep('MonT', 1)} AS MonT, {HALF} AS YrSide,
  {r6("sum(CASE WHEN St_Rain > 0 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) * 100")} AS RainProb FROM e2e GROUP BY 1, 2, 3""",
)


def quant(p: float, x: str) -> str:
    return f"quantile_cont({x}, CAST({p} AS DOUBLE))"


def long_form(src: str, keys: str, names: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT {keys}, '{n}' AS Qntile, {r6(f'"{n}"')} AS Sum_Precip FROM {src}""" for n in names
    )


QN = ["95%", "75%", "50%"]
add(
    "depth_quantiles",
    D + "," + sample("e2e", 7) + "," + FAN + f""",
q AS (SELECT MonT, Sum_Press_Delta, Season, {", ".join(f'{quant(p, "Sum_Precip")} AS "{n}"' for p, n in zip((0.95, 0.75, 0.5), QN))}
  FROM fo GROUP BY 1, 2, 3),
u AS ({long_form("q", "MonT, Sum_Press_Delta, Season", QN)})""",
    f"SELECT *, {band('Sum_Press_Delta', 300)} AS Sum_Press_C FROM u",
)
SN = {"99.9%": 0.999, "99%": 0.99, "90%": 0.9, "75%": 0.75, "50%": 0.5, "25%": 0.25}
add(
    "depth_quantile_surface",
    D + "," + sample("e2e", None) + f""",
q AS (SELECT MonT, Sum_Press_Delta, {", ".join(f'{quant(p, "Sum_Precip")} AS "{n}"' for n, p in SN.items())} FROM sm GROUP BY 1, 2)""",
    long_form("q", "MonT, Sum_Press_Delta", list(SN)),
)
add(
    "unpivot_quantiles",
    D + f""",
q AS (SELECT Location, {", ".join(f'{quant(p, "Dur")} AS "{n}"' for p, n in zip((0.95, 0.75, 0.5), QN))} FROM e2e GROUP BY 1)""",
    long_form("q", "Location", QN),
)
add(
    "neighbour_fanout",
    D + "," + sample("e2e", 7, WET) + "," + FAN,
    f"SELECT MonT, Sum_Press_Delta, Season, {r6('Sum_Precip')} AS Sum_Precip FROM fo",
)
TN = ["95 Percentile", "75 Percentile", "50 Percentile"]


def tails(expr: str, where: str) -> tuple[str, str]:
    q = ", ".join(f"quantile_cont(Sum_Precip, CAST({p} AS DOUBLE)) AS q{i}" for i, p in enumerate((0.95, 0.75, 0.5)))
    t = ", ".join(f'{expr.format(q=f"q{i}")} AS "{n}"' for i, n in enumerate(TN))
    ctes = D + "," + sample("e2e", 7, WET) + "," + FAN + f""",
qq AS (SELECT MonT, Sum_Press_Delta, Season, {q} FROM fo GROUP BY 1, 2, 3),
t AS (SELECT fo.MonT, fo.Sum_Press_Delta, fo.Season, {t} FROM fo JOIN qq ON fo.MonT IS NOT DISTINCT FROM qq.MonT
  AND fo.Sum_Press_Delta IS NOT DISTINCT FROM qq.Sum_Press_Delta AND fo.Season = qq.Season GROUP BY 1, 2, 3),
tw AS (SELECT * FROM t {where}),
u AS ({long_form("tw", "MonT, Sum_Press_Delta, Season", TN)})"""
    return ctes, f"SELECT *, {band('Sum_Press_Delta', 300)} AS Sum_Press_C FROM u"


add("tail_mean", *tails("avg(CASE WHEN Sum_Precip > {q} THEN Sum_Precip END)", "WHERE abs(Sum_Press_Delta) < 2000"))
add("tail_mean_zero", *tails("avg(CASE WHEN Sum_Precip > {q} THEN Sum_Precip ELSE 0e0 END)", ""))
EXT = D + """,
xt AS (SELECT * FROM e2e WHERE Sum_Precip > (SELECT quantile_cont(Sum_Precip, CAST(0.95 AS DOUBLE)) FROM e2e))"""
add("extreme_events", EXT, f"SELECT Location, Press_Evt_lab, {r6('Sum_Precip')} AS Sum_Precip FROM xt")
add(
    "extreme_pop_by_epc",
    EXT,
    f'SELECT {rstep("Sum_Press_Delta", 20)} AS Evt_Press_chng, {POP} AS RainProb, count(*) AS samplesize FROM xt GROUP BY 1',
)

WEEK_ROWS = DC + """,
wr AS (SELECT * REPLACE (coalesce(CMI, 0e0) AS CMI, coalesce(CMI_pre, 0e0) AS CMI_pre), (dayofyear(Time) - 1) // 7 + 1 AS Wk FROM l3
  WHERE Time BETWEEN TIMESTAMP '1992-01-01 00:00:00' AND TIMESTAMP '2001-12-31 23:59:59')"""


def ratio(x: str, n: str) -> str:
    x = snap(x)
    inner = f"""coalesce(CASE WHEN {n} <> 0 THEN {x} / {n} WHEN {x} > 0 THEN CAST('Infinity' AS DOUBLE)
  WHEN {x} < 0 THEN CAST('-Infinity' AS DOUBLE) END, 0e0)"""
    return r6(inner)


PCE_N = "(max(Press_Evt_lab) - min(Press_Evt_lab))"
WEEKS = WEEK_ROWS + f""",
wk AS (SELECT Yr, Mon, Wk, Location, {snap("sum(CMI)")} AS CMI, {snap("sum(CMI_pre)")} AS CMI_pre, {PCE_N} AS PCE_num,
  coalesce({strict("sum", "Rain")}, 0e0) AS wk_Rain, {ratio(strict("sum", "Temp_C"), PCE_N)} AS cum_Temp,
  {ratio(strict("sum", "RH"), PCE_N)} AS cum_RH, {ratio(strict("sum", "(Temp_C - DewPt_C)"), PCE_N)} AS Temp_dew_diff,
  {strict("sum", "pressure_chng_av")} AS cum_Pressure_chng FROM wr GROUP BY 1, 2, 3, 4)"""
WEEK_COLS = f"""Yr, Mon, Wk, Location, {r6("CMI")} AS CMI, {r6("CMI_pre")} AS CMI_pre, PCE_num, {r6("wk_Rain")} AS wk_Rain,
  cum_Temp, cum_RH, Temp_dew_diff, {r6("cum_Pressure_chng")} AS cum_Pressure_chng"""
add("weekly_cmi", WEEKS, f"SELECT {WEEK_COLS} FROM wk")
add(
    "weekly_drought",
    "RECURSIVE "
    + WEEKS.replace(DC, full_ctes(DAILY_CMI_READINGS, 1440, 5760, measures=[*MEASURES, "CMI", "CMI_pre"], fill="spline"))
    + f""",
z AS (SELECT *, {snap("(CMI - (SELECT avg(CMI) FROM wk)) / (SELECT stddev_samp(CMI) FROM wk)")} AS CMI_standarize FROM wk)""",
    f"SELECT {WEEK_COLS}, {r6('CMI_standarize')} AS CMI_standarize FROM z WHERE CMI_standarize < -1",
)
add(
    "weekly_means",
    WEEK_ROWS + f""",
wm AS (SELECT Yr, Mon, Wk, Location, {r6(snap("sum(CMI)"))} AS CMI, {PCE_N} AS PCE_num,
  {ratio(strict("avg", "Temp_C"), PCE_N)} AS mean_Temp, {ratio(strict("avg", "RH"), PCE_N)} AS mean_RH,
  {ratio(strict("avg", "(Temp_C - DewPt_C)"), PCE_N)} AS Temp_dew_diff FROM wr GROUP BY 1, 2, 3, 4)""",
    "SELECT wm.*, wr.Time FROM wr JOIN wm USING (Yr, Mon, Wk, Location)",
)
WPC = WEEK_ROWS + f""",
wp AS (SELECT Yr, Mon, Wk, Location, {PCE_N} AS PCE_num, {snap("sum(CMI)")} AS CMI, {snap("sum(Rain)")} AS Rain,
  CAST(Yr AS VARCHAR) || ' ' || CAST(Wk AS VARCHAR) AS year_wk FROM wr GROUP BY 1, 2, 3, 4)"""
add(
    "weekly_pce_count",
    WPC,
    f"""SELECT Yr, Mon, Wk, Location, wr.Time, PCE_num, {r6("wp.CMI")} AS CMI, {r6("wp.Rain")} AS Rain, year_wk
  FROM wr JOIN wp USING (Yr, Mon, Wk, Location)""",
)
add(
    "zscore_filter",
    WEEKS + f""",
z AS (SELECT *, {snap("(CMI - (SELECT avg(CMI) FROM wk)) / (SELECT stddev_samp(CMI) FROM wk)")} AS CMI_standarize FROM wk)""",
    f"SELECT Location, Yr, Mon, Wk, {r6('CMI')} AS CMI, {r6('CMI_standarize')} AS CMI_standarize FROM z WHERE CMI_standarize < -1",
)
add(
    "weekly_extract",
    WPC,
    f"""SELECT DISTINCT Yr, Mon, Wk, Location, PCE_num, {r6("wp.CMI")} AS CMI, {r6("wp.Rain")} AS Rain, year_wk,
  CASE WHEN Mon BETWEEN 4 AND 10 THEN 'wet' ELSE 'dry' END AS wet_dry FROM wp WHERE (CMI >= 0.5 OR CMI <= -0.5) AND PCE_num <= 5""",
)


add(
    "weekly_extract_dry",
    WEEKS + f""",
z AS (SELECT *, {snap("(CMI - (SELECT avg(CMI) FROM wk)) / (SELECT stddev_samp(CMI) FROM wk)")} AS CMI_standarize FROM wk)""",
    f"""SELECT DISTINCT Yr, Mon, Wk, Location, {r6("CMI_standarize")} AS CMI_standarize, Temp_dew_diff,
  {r6("cum_Pressure_chng")} AS cum_Pressure_chng, CASE WHEN PCE_num > 2 THEN '>2' ELSE '<2' END AS wet_dry
  FROM z WHERE CMI_standarize < -1 AND CMI_pre <= 0 AND CASE WHEN Temp_dew_diff > 0 THEN ln(Temp_dew_diff) > 1 ELSE FALSE END""",
)


def daily_cte(src: str, name: str = "da") -> str:
    return f"""
{name} AS (SELECT Location, CAST(Time AS DATE) AS Time_SPI, {snap(strict("sum", "Rain"))} AS Day_rain,
  {snap(f"({strict('max', 'Pressure_hPa')}) - ({strict('min', 'Pressure_hPa')})")} AS Day_Pressure_chng_av,
  {snap(strict("avg", "(Temp_C - DewPt_C)"))} AS Temp_dew_diff FROM {src} GROUP BY 1, 2)"""


add(
    "daily_agg",
    H + "," + daily_cte("l3"),
    f"""SELECT Location, Time_SPI, {r6("Day_rain")} AS Day_rain, {r6("Day_Pressure_chng_av")} AS Day_Pressure_chng_av,
  {r6("Temp_dew_diff")} AS Temp_dew_diff, year(Time_SPI) AS Yr, month(Time_SPI) AS Mon FROM da""",
)


def rolled_cte(days: int = 30) -> str:
    return f"""
ro AS (SELECT Location, Time_SPI, CASE WHEN count(Day_rain) OVER w = {days} THEN {snap("sum(Day_rain) OVER w")} END AS rain_sum FROM da
  WINDOW w AS (PARTITION BY Location ORDER BY Time_SPI RANGE BETWEEN INTERVAL {days - 1} DAYS PRECEDING AND CURRENT ROW)),
rr AS (SELECT * FROM ro WHERE rain_sum IS NOT NULL)"""


ROLL = ",".join([D_LAB, daily_cte("l"), rolled_cte()])
add("rolling_rain", ROLL, f"SELECT Location, Time_SPI, {r6('rain_sum')} AS rain_sum FROM ro")
add(
    "spi_gamma_params",
    ROLL + f""",
pa AS (SELECT Location, CAST(dayofyear(Time_SPI) AS INT) AS doy, count(*) AS n,
  sum(CASE WHEN rain_sum = 0 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS zero_share,
  avg(CASE WHEN rain_sum > 0 THEN rain_sum END) AS mean,
  avg(CASE WHEN rain_sum > 0 THEN ln(CASE WHEN rain_sum > 0 THEN rain_sum END) END) AS log_mean FROM rr GROUP BY 1, 2),
pb AS (SELECT *, {snap('ln(mean) - log_mean', 12)} AS a FROM pa),
pc AS (SELECT *, CASE WHEN a > 1e-9 THEN (sqrt(a * 4e0 / 3e0 + 1e0) + 1e0) / (a * 4e0) END AS shape FROM pb)""",
    f"SELECT Location, doy, n, {r6('zero_share')} AS zero_share, {r6('shape')} AS shape, {r6('mean / shape')} AS scale FROM pc",
)


def _normal(v: str) -> str:
    """Normal distribution function by its power series: half, and the density times v + v^3/3 + v^5/15 + ..."""
    term = "exp((2 * n + 1) * ln(greatest(abs({v}), 1e-300)) - lgamma(2 * n + 2) + n * ln(2) + lgamma(n + 1))"
    total = f"list_sum(list_transform(range(0, 120), lambda n: {term.format(v=v)}))"
    return f"(0.5e0 + sign({v}) * exp(-{v} * {v} / 2) / sqrt(2 * pi()) * {total})"


def index_ctes(keys: str, roll: str = ROLL, within: str = "year(Time_SPI) BETWEEN 1995 AND 2001") -> str:
    """The precipitation index into ``spi``: gamma mass by its power series, normal quantile by Newton steps."""
    return roll + f""",
dy AS (SELECT *, CAST(dayofyear(Time_SPI) AS INT) AS doy FROM ro),
pa AS (SELECT {keys}, sum(CASE WHEN rain_sum = 0 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS zero,
  avg(CASE WHEN rain_sum > 0 THEN rain_sum END) AS mean,
  avg(CASE WHEN rain_sum > 0 THEN ln(CASE WHEN rain_sum > 0 THEN rain_sum END) END) AS log_mean
  FROM dy WHERE rain_sum IS NOT NULL GROUP BY {keys}),
pb AS (SELECT *, {snap('ln(mean) - log_mean', 12)} AS a FROM pa),
pc AS (SELECT *, CASE WHEN a > 1e-9 THEN (sqrt(a * 4e0 / 3e0 + 1e0) + 1e0) / (a * 4e0) END AS s FROM pb),
ask AS (SELECT Location, Time_SPI, rain_sum, zero, s, CASE WHEN rain_sum > 0 THEN rain_sum * s / mean END AS z
  FROM dy LEFT JOIN pc USING ({keys}) WHERE {within}),
mass AS (SELECT *, CASE WHEN rain_sum = 0 THEN 0e0 ELSE least(1e0, list_sum(list_transform(
  range(0, CAST(greatest(z - s, 0) + 10 * sqrt(greatest(z, s)) + 100 AS BIGINT)),
  lambda n: exp((s + n) * ln(z) - z - lgamma(s + n + 1))))) END AS g FROM ask),
pr AS (SELECT *, zero + (1 - zero) * g AS p FROM mass),
spi AS (SELECT Location, Time_SPI AS time_stamp, rain_sum, CASE WHEN p > 0 AND p < 1 THEN list_reduce(range(0, 12),
  lambda v, i: v - ({_normal("v")} - p) / (exp(-v * v / 2) / sqrt(2 * pi())),
  (pow(p, 0.135e0) - pow(1 - p, 0.135e0)) / 0.1975e0) END AS value FROM pr)"""


INDEX = index_ctes("Location, doy") + "," + daily_cte("r", "raw")
for key, ctes in (("spi_daily", INDEX), ("spi_daily_pooled", index_ctes("doy"))):
    add(key, ctes, f"SELECT Location, time_stamp, {r6('rain_sum')} AS rain_sum, {r6('value')} AS value FROM spi")
INDEX_DAYS = INDEX + """,
sj AS (SELECT spi.*, Day_rain, Day_Pressure_chng_av, Temp_dew_diff FROM spi
  LEFT JOIN raw ON raw.Location = spi.Location AND raw.Time_SPI = spi.time_stamp)"""
add(
    "join_spi_daily",
    INDEX_DAYS,
    "SELECT Location, time_stamp, "
    + ", ".join(f"{r6(c)} AS {c}" for c in ("value", "Day_rain", "Day_Pressure_chng_av", "Temp_dew_diff"))
    + " FROM sj",
)
SPI_WEEKS = f""",
ws AS (SELECT Location, year(time_stamp) AS Yr, month(time_stamp) AS Mon, (dayofyear(time_stamp) - 1) // 7 + 1 AS Wk, avg(value) AS a,
  {snap("coalesce(sum(Day_Pressure_chng_av), 0e0)")} AS p, {snap("coalesce(sum(Temp_dew_diff), 0e0)")} AS d FROM sj GROUP BY 1, 2, 3, 4)"""
SPI_WEEK_ROWS = f"""SELECT Location, Yr, Mon, Wk, {r6("a")} AS spi_av, {r6("p")} AS pre_sum, {r6("d")} AS diff_T_D,
  {fstep("d", 40)} AS dew_band FROM ws WHERE p <> 0"""
add("weekly_spi", INDEX_DAYS + SPI_WEEKS, SPI_WEEK_ROWS)
add(
    "weekly_precipitation",
    "RECURSIVE "
    + index_ctes("doy", ",".join([H_SPLINE, daily_cte("l3"), rolled_cte(3)]), "TRUE")
    + """,
sj AS (SELECT spi.*, Day_rain, Day_Pressure_chng_av, Temp_dew_diff FROM spi
  LEFT JOIN da ON da.Location = spi.Location AND da.Time_SPI = spi.time_stamp)"""
    + SPI_WEEKS,
    SPI_WEEK_ROWS,
)
add(
    "monthly_spi",
    INDEX_DAYS,
    f"""SELECT Location, year(time_stamp) AS Yr, month(time_stamp) AS Mon, {r6(strict("avg", "value"))} AS SPI,
  {r6(strict("avg", "Day_Pressure_chng_av"))} AS pressure_chng, {r6(strict("avg", "Temp_dew_diff"))} AS temp_dew FROM sj GROUP BY 1, 2, 3""",
)
add(
    "gap_census",
    HOURLY_READINGS + """,
bk AS (SELECT Location, (epoch_us(Time) + 1800000000) // 3600000000 AS step FROM r WHERE Temp_C IS NOT NULL GROUP BY 1, 2),
lk AS (SELECT Location, lead(step) OVER (PARTITION BY Location ORDER BY step) - step AS gap FROM bk)""",
    """SELECT Location, CASE WHEN gap <= 1 THEN '(0,1]' WHEN gap <= 6 THEN '(1,6]' WHEN gap <= 24 THEN '(6,24]'
  WHEN gap > 24 THEN '(24,Inf]' END AS gp, count(*) AS n FROM lk GROUP BY 1, 2""",
)
SHARE = r6("sum(CASE WHEN rain0 > 0 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE)") + " AS PRate"
add("pop_by_slp", H_LAB, f"SELECT {fstep(snap('Pressure_hPa'), 1)} AS SLP_v, {SHARE} FROM l GROUP BY 1")
add(
    "pop_by_slp_month",
    D_LAB,
    f"SELECT {fstep(snap('Pressure_hPa'), 1)} AS SLP_v, monthname(Time) AS Mon, {SHARE}, count(*) AS Occurance FROM l GROUP BY 1, 2",
)
add(
    "daily_pressure_hist",
    H_LAB + f""",
dp AS (SELECT Location, date_trunc('day', Time) AS Date, {snap("avg(Pressure_hPa)")} AS p FROM l GROUP BY 1, 2)""",
    "SELECT month(Date) AS Month, ceil(p - 0.5e0) AS bin, count(*) AS n FROM dp WHERE p IS NOT NULL GROUP BY 1, 2",
)
add(
    "tail_sample_size",
    D,
    f"""SELECT {KIND} AS PCEType, {AMT02} AS MonT, count(*) AS n FROM e2e WHERE Mon >= 7 AND {rstep("MonT", 0.2)} < 5
  AND Sum_Press_Delta >= 0 GROUP BY 1, 2""",
)
add(
    "tail_sample_size_fanned",
    D + "," + sample("e2e", None) + "," + FAN,
    "SELECT Season, MonT, count(*) AS n FROM fo WHERE Sum_Press_Delta > 0 AND MonT > 10 GROUP BY 1, 2",
)
add(
    "hist_amt",
    D + """,
en AS (SELECT min(MonT) AS lo, max(MonT) AS hi FROM e2e)""",
    """SELECT CAST(least(floor((MonT - lo) / (hi - lo) * 30), 29) AS BIGINT) AS bin, count(*) AS n_all,
  CAST(sum(CASE WHEN St_Rain > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_rainy FROM e2e, en WHERE MonT IS NOT NULL GROUP BY 1""",
)
add(
    "box_stats",
    D_LAB + f""",
mt AS (SELECT Location, Yr, Mon, {snap("avg(Temp_C)")} AS MonT FROM l GROUP BY 1, 2, 3),
q AS (SELECT Mon, {quant(0.25, "MonT")} AS q1, {quant(0.5, "MonT")} AS median, {quant(0.75, "MonT")} AS q3 FROM mt GROUP BY 1),
v AS (SELECT mt.Mon, MonT, q1, median, q3, MonT >= q1 - (q3 - q1) * 1.5e0 AND MonT <= q3 + (q3 - q1) * 1.5e0 AS inside
  FROM mt JOIN q USING (Mon) WHERE MonT IS NOT NULL)""",
    f"""SELECT Mon, {r6("max(q1)")} AS q1, {r6("max(median)")} AS median, {r6("max(q3)")} AS q3,
  {r6("min(CASE WHEN inside THEN MonT END)")} AS whisker_low, {r6("max(CASE WHEN inside THEN MonT END)")} AS whisker_high,
  count(*) AS n, CAST(sum(CASE WHEN inside THEN 0 ELSE 1 END) AS BIGINT) AS outliers FROM v GROUP BY 1""",
)
add(
    "event_scatter",
    D,
    f"SELECT {r6('Sum_Press_Delta')} AS Sum_Press_Delta, {r6('Sum_Precip')} AS Sum_Precip FROM e2e WHERE Sum_Precip > 0",
)
add(
    "event_scatter_amt",
    D,
    f"""SELECT {r6("MonT")} AS MonT, {r6("Sum_Precip")} AS Sum_Precip, CASE WHEN MonT < 12 THEN 'Winter' ELSE 'Summer' END AS YrSide,
  {KIND} AS PCEType FROM e2e WHERE Sum_Precip > 0.01""",
)

# -- windows -------------------------------------------------------------------------------------------

add(
    "rolling_sum",
    H_GRID + "," + rain_ctes("s"),
    f"SELECT Location, Time, {r6('ahead')} AS sum_left, {r6('behind')} AS sum_right FROM rs",
)
add("rolling_mean_centered", H_SMOOTH, f"SELECT Location, Time, {r6('pressure_av')} AS pressure_av FROM m")
_vars = {"Pressure_hPa": "slp", "Temp_C": "temp", "DewPt_C": "dewpt", "RH": "rhx"}
_edge = ", ".join(
    f"max(CASE WHEN {c} IS NOT NULL THEN step END) OVER a AS p_{n}, min(CASE WHEN {c} IS NOT NULL THEN step END) OVER z AS n_{n}"
    for c, n in _vars.items()
)
_fill = ", ".join(
    f"""coalesce(k.{c}, p{n}.{c} + (n{n}.{c} - p{n}.{c}) * CAST(k.step - k.p_{n} AS DOUBLE) / CAST(k.n_{n} - k.p_{n} AS DOUBLE)) AS {n}_spl"""
    for c, n in _vars.items()
)
_joins = "".join(
    f""" LEFT JOIN b p{n} ON p{n}.Location = k.Location AND p{n}.step = k.p_{n}
  LEFT JOIN b n{n} ON n{n}.Location = k.Location AND n{n}.step = k.n_{n}"""
    for n in _vars.values()
)
_avs = ", ".join(
    r6(f"CASE WHEN count({n}_spl) OVER w = 24 THEN avg({n}_spl) OVER w END") + f" AS {n}_av" for n in _vars.values()
)
add(
    "smooth_variables",
    H_GRID + f""",
k AS (SELECT *, {_edge} FROM s WINDOW a AS (PARTITION BY Location ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  z AS (PARTITION BY Location ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT k.Location, k.step, k.Time, {_fill} FROM k{_joins})""",
    f"""SELECT Location, Time, {_avs} FROM f
  WINDOW w AS (PARTITION BY Location ORDER BY step ROWS BETWEEN 11 PRECEDING AND 12 FOLLOWING)""",
)
add("pressure_change_24h", H_SMOOTH, f"SELECT Location, Time, {r6('pressure_chng_av')} AS pressure_chng_av FROM c")
for key, rule in (("rain_dry_labels", "A"), ("rain_dry_labels_b", "B")):
    add(
        key,
        H_GRID + "," + rain_ctes("s", rule),
        f"""SELECT Location, Time, {r6("rain0")} AS Rain, StR, StD, CAST(sum(StR + StD) OVER (PARTITION BY Location ORDER BY step
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS Evt_lab FROM fl""",
    )
add(
    "pressure_event_labels",
    D_LAB,
    f"SELECT Location, Time, Mon, {r6('pressure_chng_av')} AS pressure_chng_av, Press_Evt_lab FROM l",
)

# -- fills, fits, densities -----------------------------------------------------------------------------

add(
    "linear_fill",
    D_SMOOTH,
    f"SELECT Location, Time, {r6('Pressure_hPa')} AS Pressure_hPa, {r6('pressure_spl')} AS pressure_spl FROM f",
)
add(
    "spline_fill",
    "RECURSIVE " + smooth_ctes(DAILY_READINGS, 1440, fill="spline"),
    f"SELECT Location, Time, {r6('Pressure_hPa')} AS Pressure_hPa, {r6('pressure_spl')} AS pressure_spl FROM f",
)
_splines = ",".join(spline_ctes(c, f"{n}_") for c, n in _vars.items())
_cubics = ", ".join(f"{cubic(f'k.{c}', 'k.step', f'{n}_co')} AS {n}_spl" for c, n in _vars.items())
_ends = ", ".join(edges(c, f"{n}_") for c, n in _vars.items())
_at = "".join(
    f"\n  LEFT JOIN {n}_co ON {n}_co.Location = k.Location AND {n}_co.step = coalesce(k.{n}_ps, k.{n}_ns)" for n in _vars.values()
)
add(
    "smooth_variables_spline",
    "RECURSIVE " + H_GRID + "," + _splines + f""",
k AS (SELECT *, {_ends} FROM s WINDOW {EDGES}),
f AS (SELECT k.Location, k.step, k.Time, {_cubics} FROM k{_at})""",
    f"""SELECT Location, Time, {_avs} FROM f
  WINDOW w AS (PARTITION BY Location ORDER BY step ROWS BETWEEN 11 PRECEDING AND 12 FOLLOWING)""",
)
TERMS = {"one": "1e0", "s1": "sin(h)", "c1": "cos(h)", "s2": "sin(2 * h)", "c2": "cos(2 * h)"}
_names = list(TERMS)
_sums = []
for _i, _a in enumerate(_names):
    for _b in _names[_i:]:
        _sums.append(f"{r6(f'sum({TERMS[_a]} * {TERMS[_b]})')} AS {_a}_{_b}")
    _sums.append(f"{r6(f'sum({TERMS[_a]} * d)')} AS {_a}_y")
add(
    "harmonic_normal_eq",
    H_GRID + """,
ch AS (SELECT Location, hour(Time) * 2 * pi() / 24 AS h, Temp_C - lag(Temp_C) OVER (PARTITION BY Location ORDER BY step) AS d FROM s)""",
    f"SELECT Location, {', '.join(_sums)} FROM ch WHERE d IS NOT NULL GROUP BY 1",
)

#: Normal equations per station solved by Gauss-Jordan steps; the fitted change of each row's
#: hour is added up over the series.
add(
    "harmonic_fill",
    "RECURSIVE " + H_GRID + f""",
ch AS (SELECT Location, hour(Time) * 2 * pi() / 24 AS h, Temp_C - lag(Temp_C) OVER (PARTITION BY Location ORDER BY step) AS d FROM s),
tm AS (SELECT Location, d, [{", ".join(TERMS.values())}] AS t FROM ch WHERE d IS NOT NULL),
ne AS (SELECT Location, a.i, c.j, sum(t[a.i] * CASE WHEN c.j = 6 THEN d ELSE t[c.j] END) AS w FROM tm, range(1, 6) a(i), range(1, 7) c(j) GROUP BY ALL),
nr AS (SELECT Location, i, list(w ORDER BY j) AS m FROM ne GROUP BY ALL),
gj AS (SELECT Location, 1 AS p, list(m ORDER BY i) AS m FROM nr GROUP BY Location
  UNION ALL SELECT Location, p + 1, list_transform(range(1, 6), lambda r: CASE WHEN r = p THEN list_transform(m[p], lambda v: v / m[p][p])
    ELSE list_transform(range(1, 7), lambda c: m[r][c] - m[r][p] * m[p][c] / m[p][p]) END) FROM gj WHERE p <= 5),
be AS (SELECT Location, list_transform(m, lambda r: r[6]) AS b FROM gj WHERE p = 6),
pf AS (SELECT Location, step, Time, Temp_C, sum(list_dot_product(b, [{", ".join(TERMS.values())}])) OVER o AS moved,
  max(CASE WHEN Temp_C IS NOT NULL THEN step END) OVER o AS ks,
  count(*) OVER o > 1 AND lag(Temp_C) OVER q IS NULL OR step < max(step) OVER (PARTITION BY Location) AND lead(Temp_C) OVER q IS NULL AS beside
  FROM (SELECT *, hour(Time) * 2 * pi() / 24 AS h FROM s) JOIN be USING (Location)
  WINDOW o AS (PARTITION BY Location ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY Location ORDER BY step))""",
    f"""SELECT pf.Location, pf.Time, {r6("pf.Temp_C")} AS Temp_C,
  {r6("CASE WHEN pf.Temp_C IS NULL THEN k.Temp_C + pf.moved - k.moved WHEN pf.beside THEN pf.Temp_C END")} AS temp_cure
  FROM pf LEFT JOIN pf k ON k.Location = pf.Location AND k.step = pf.ks""",
)


def kde(kind: str, where: str) -> str:
    """The kernel summed directly over all values."""
    return f"""SELECT '{kind}' AS kind, i, {r6("lo - 3 * h + (hi - lo + 6 * h) * i / 255")} AS x, {r6(
        "sum(exp(-0.5e0 * pow((lo - 3 * h + (hi - lo + 6 * h) * i / 255 - v) / h, 2))"
        " / sqrt(2 * pi()) / (h * n))")} AS density
  FROM (SELECT Sum_Press_Delta AS v FROM ke WHERE {where}),
    (SELECT count(*) AS n, min(Sum_Press_Delta) AS lo, max(Sum_Press_Delta) AS hi,
       0.9e0 * least(stddev_samp(Sum_Press_Delta), ({quant(0.75, "Sum_Press_Delta")} - {quant(0.25, "Sum_Press_Delta")}) / 1.34e0)
       * pow(count(*), -0.2e0) AS h FROM ke WHERE {where}) s, range(0, 256) t(i) GROUP BY i, lo, hi, h"""


add(
    "kde_1d",
    D + """,
ke AS (SELECT * FROM e2e WHERE abs(Sum_Press_Delta) > 5.5)""",
    kde("all", "TRUE") + " UNION ALL " + kde("rainy", "St_Rain > 0"),
)


def _axis(c: str, p: str) -> str:
    return f"""min({c}) AS {p}lo, max({c}) AS {p}hi, 1.06e0 * least(stddev_samp({c}), ({quant(0.75, c)} - {quant(0.25, c)}) / 1.34e0)
    * pow(count(*), -0.2e0) AS {p}h"""


add(
    "kde_2d",
    D + f""",
ke AS (SELECT Sum_Press_Delta AS x, Sum_Precip AS y FROM e2e WHERE Sum_Precip > 0 AND Sum_Press_Delta IS NOT NULL),
st AS (SELECT count(*) AS n, {_axis("x", "x")}, {_axis("y", "y")} FROM ke)""",
    f"""SELECT i, j, {r6("xlo + (xhi - xlo) * i / 24")} AS x, {r6("ylo + (yhi - ylo) * j / 24")} AS y,
  {r6("sum(exp(-0.5e0 * pow((xlo + (xhi - xlo) * i / 24 - x) / xh, 2)) * exp(-0.5e0 * pow((ylo + (yhi - ylo) * j / 24 - y) / yh, 2))"
      " / (2 * pi()) / (xh * yh * n))")} AS density
  FROM ke, st, range(0, 25) a(i), range(0, 25) b(j) GROUP BY i, j, xlo, xhi, ylo, yhi""",
)
add(
    "monday_dates",
    """j AS (SELECT o_orderkey, make_date(CAST(year(o_orderdate) AS BIGINT), 1, 1) AS j1, (dayofyear(o_orderdate) - 1) // 7 AS w FROM orders),
f AS (SELECT *, j1 + CAST((8 - isodow(j1)) % 7 AS INT) AS first FROM j)""",
    "SELECT o_orderkey, CASE WHEN w = 0 AND first = j1 THEN j1 ELSE first + CAST((w - 1) * 7 AS INT) END AS monday FROM f",
)


def _t(df: str) -> str:
    """Student's 97.5 % point by its expansion around the normal one."""
    z = NormalDist().inv_cdf(0.975)
    return f"""({z}e0 + {(z**3 + z) / 4}e0 / {df} + {(5 * z**5 + 16 * z**3 + 3 * z) / 96}e0 / pow({df}, 2)
    + {(3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384}e0 / pow({df}, 3)
    + {(79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160}e0 / pow({df}, 4))"""


#: From ``pt(g, x, y)``: rows ``l`` of the operator matrix at 80 grid points and at every data point.
LOCAL = """
row_ AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY x, y) AS j FROM pt WHERE x IS NOT NULL AND y IS NOT NULL),
range_ AS (SELECT g, min(x) AS lo, max(x) AS hi, greatest(1, floor(0.75e0 * count(*) + 1e-9)) AS need FROM row_ GROUP BY g),
ev AS (SELECT g, i, 0 AS own, lo + (hi - lo) * i / 79 AS a, need FROM range_, range(0, 80) t(i)
  UNION ALL SELECT g, -j, j, x, need FROM row_ JOIN range_ USING (g)),
dist AS (SELECT g, i, own, a, need, j, x, y, abs(x - a) AS d, row_number() OVER (PARTITION BY g, i ORDER BY abs(x - a)) AS nth
  FROM ev JOIN row_ USING (g)),
rad AS (SELECT g, i, d AS r FROM dist WHERE nth = need),
wt AS (SELECT g, i, own, a, j, y, (x - a) / r AS u, pow(1 - pow(d / r, 3), 3) AS w FROM dist JOIN rad USING (g, i) WHERE d < r),
mom AS (SELECT g, i, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * u * u * u) AS s3, sum(w * u * u * u * u) AS s4 FROM wt GROUP BY g, i),
inv AS (SELECT g, i, s2 * s4 - s3 * s3 AS c0, s2 * s3 - s1 * s4 AS c1, s1 * s3 - s2 * s2 AS c2,
  s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM mom),
op AS (SELECT g, i, own, a, j, y, w * (c0 + c1 * u + c2 * u * u) / det AS l FROM wt JOIN inv USING (g, i)),
fits AS (SELECT g, i, own, a, sum(l * y) AS fit, sum(l * l) AS norm, sum(CASE WHEN j = own THEN l END) AS lev FROM op GROUP BY g, i, own, a)"""

add(
    "local_curve_band",
    D + f""",
pt AS (SELECT {HALF} AS g, {rstep('MonT', 0.2)} AS x, {RAIN_SHARE} AS y FROM e2e WHERE Sum_Press_Delta < 0 GROUP BY 1, 2),{LOCAL},
left_ AS (SELECT f.g, count(*) - 2 * sum(lev) + sum(norm) AS df, sum(pow(p.y - fit, 2)) AS rss
  FROM fits f JOIN row_ p ON p.g = f.g AND p.j = f.own GROUP BY f.g),
band AS (SELECT g, a, fit, sqrt(rss / df * norm) AS se, df FROM fits JOIN left_ USING (g) WHERE i >= 0)""",
    f"""SELECT g AS YrSide, {r6("a")} AS MonT, {r6("fit")} AS fit, {r6("se")} AS se,
  {r6(f"fit - se * {_t('df')}")} AS low, {r6(f"fit + se * {_t('df')}")} AS high FROM band""",
)
add(
    "local_curve_by_group",
    D + f""",
pt AS (SELECT {{'h': {HALF}, 'k': {KIND}}} AS g, {rstep('MonT', 0.2)} AS x, {RAIN_SHARE} AS y FROM e2e GROUP BY {HALF}, {KIND}, {rstep('MonT', 0.2)}),{LOCAL}""",
    f"SELECT g.h AS YrSide, g.k AS PCEType, {r6('a')} AS MonT, {r6('fit')} AS fit FROM fits WHERE i >= 0",
)
#: Natural splines in truncated powers of x scaled to the range, solved by Gauss-Jordan steps.
add(
    "frequency_smooth",
    "RECURSIVE " + D + f""",
pt AS (SELECT {HALF} AS g, MonT AS x0, CAST(count(*) AS DOUBLE) AS y FROM e2e WHERE MonT IS NOT NULL GROUP BY Location, Yr, Mon, MonT),
ends_ AS (SELECT g, min(x0) AS lo, max(x0) AS hi FROM pt GROUP BY g),
knot AS (SELECT g, list_transform(range(0, 10), lambda j: (kn[j + 1] - lo) / (hi - lo)) AS k, lo, hi FROM (
  SELECT g, quantile_cont(x0, [0e0, 1/9e0, 2/9e0, 3/9e0, 4/9e0, 5/9e0, 6/9e0, 7/9e0, 8/9e0, 1e0]) AS kn
  FROM (SELECT DISTINCT g, x0 FROM pt) GROUP BY g) JOIN ends_ USING (g)),
at_ AS (SELECT g, -1 AS i, (x0 - lo) / (hi - lo) AS x, y, k FROM pt JOIN knot USING (g)
  UNION ALL SELECT g, i, i / 79e0, NULL, k FROM knot, range(0, 80) t(i)),
pw AS (SELECT *, list_transform(range(1, 10), lambda j:
  (pow(greatest(x - k[j], 0), 3) - pow(greatest(x - k[10], 0), 3)) / (k[10] - k[j])) AS d FROM at_),
bs AS (SELECT g, i, y, list_concat([1e0, x], list_transform(range(1, 9), lambda j: d[j] - d[9])) AS b FROM pw),
seg AS (SELECT g, k, s, unnest([k[s], (k[s] + k[s + 1]) / 2, k[s + 1]]) AS v, unnest([1, 4, 1]) AS q FROM knot, range(1, 10) t(s)),
sec AS (SELECT g, q * (k[s + 1] - k[s]) / 6 AS q, list_transform(range(1, 10), lambda j:
  6 * (greatest(v - k[j], 0) - greatest(v - k[10], 0)) / (k[10] - k[j])) AS e FROM seg),
sec2 AS (SELECT g, q, list_concat([0e0, 0e0], list_transform(range(1, 9), lambda j: e[j] - e[9])) AS e FROM sec),
om AS (SELECT g, i, j, sum(q * e[i] * e[j]) AS w FROM sec2, range(1, 11) a(i), range(1, 11) c(j) GROUP BY g, i, j),
am AS (SELECT g, a.i, c.j, sum(b[a.i] * b[c.j]) AS w FROM bs, range(1, 11) a(i), range(1, 11) c(j) WHERE bs.i < 0 GROUP BY g, a.i, c.j),
rh AS (SELECT g, a.i, sum(b[a.i] * y) AS w FROM bs, range(1, 11) a(i) WHERE bs.i < 0 GROUP BY g, a.i),
full_ AS (SELECT g, am.i, list(am.w + 50 / pow(hi - lo, 3) * om.w ORDER BY am.j) AS m FROM am JOIN om USING (g, i, j) JOIN knot USING (g) GROUP BY g, am.i),
gj AS (SELECT g, 1 AS p, list(list_concat(m, list_transform(range(1, 11), lambda c: CASE WHEN c = i THEN 1e0 ELSE 0e0 END)) ORDER BY i) AS m FROM full_ GROUP BY g
  UNION ALL SELECT g, p + 1, list_transform(range(1, 11), lambda r: CASE WHEN r = p THEN list_transform(m[p], lambda v: v / m[p][p])
    ELSE list_transform(range(1, 21), lambda c: m[r][c] - m[r][p] * m[p][c] / m[p][p]) END) FROM gj WHERE p <= 10),
inv AS (SELECT g, list_transform(m, lambda r: r[11:20]) AS v FROM gj WHERE p = 11),
beta AS (SELECT g, v, list_transform(range(1, 11), lambda r: list_dot_product(v[r], t)) AS be
  FROM inv JOIN (SELECT g, list(w ORDER BY i) AS t FROM rh GROUP BY g) USING (g)),
df_ AS (SELECT g, (SELECT count(*) FROM pt WHERE pt.g = am.g) - sum(v[i][j] * w) AS df FROM am JOIN inv USING (g) GROUP BY g),
rss_ AS (SELECT g, sum(pow(y - list_dot_product(b, be), 2)) AS rss FROM bs JOIN beta USING (g) WHERE i < 0 GROUP BY g),
out_ AS (SELECT g, lo + (hi - lo) * i / 79 AS x, list_dot_product(b, be) AS fit, df,
  sqrt(rss / df * list_dot_product(b, list_transform(v, lambda r: list_dot_product(r, b)))) AS se
  FROM bs JOIN beta USING (g) JOIN knot USING (g) JOIN df_ USING (g) JOIN rss_ USING (g) WHERE i >= 0)""",
    f"""SELECT g AS YrSide, {r6("x")} AS MonT, {r6("fit")} AS fit, {r6("se")} AS se,
  {r6(f"fit - se * {_t('df')}")} AS low, {r6(f"fit + se * {_t('df')}")} AS high FROM out_""",
)
add(
    "kde_2d_by_half",
    D + f""",
ke AS (SELECT {HALF} AS g, {rstep("MonT", 0.2)} AS x, {rstep("Sum_Press_Delta", 1)} AS y FROM e2e WHERE MonT IS NOT NULL AND Sum_Press_Delta IS NOT NULL),
st AS (SELECT g, count(*) AS n, {_axis("x", "x")}, {_axis("y", "y")} FROM ke GROUP BY g)""",
    f"""SELECT g AS YrSide, i, j, {r6("xlo + (xhi - xlo) * i / 24")} AS x, {r6("ylo + (yhi - ylo) * j / 24")} AS y,
  {r6("sum(exp(-0.5e0 * pow((xlo + (xhi - xlo) * i / 24 - x) / xh, 2)) * exp(-0.5e0 * pow((ylo + (yhi - ylo) * j / 24 - y) / yh, 2))"
      " / (2 * pi()) / (xh * yh * n))")} AS density
  FROM ke JOIN st USING (g), range(0, 25) a(i), range(0, 25) b(j) GROUP BY g, i, j, xlo, xhi, ylo, yhi""",
)
add(
    "kde_1d_wet_hours",
    H + f""",
ke AS (SELECT pressure_chng_av AS v FROM l WHERE Rain > 0 AND pressure_chng_av IS NOT NULL),
st AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi,
  0.9e0 * least(stddev_samp(v), ({quant(0.75, "v")} - {quant(0.25, "v")}) / 1.34e0) * pow(count(*), -0.2e0) AS h FROM ke)""",
    f"""SELECT i, {r6("lo - 3 * h + (hi - lo + 6 * h) * i / 255")} AS x, {r6(
        "sum(exp(-0.5e0 * pow((lo - 3 * h + (hi - lo + 6 * h) * i / 255 - v) / h, 2)) / sqrt(2 * pi()) / (h * n))")} AS density
  FROM ke, st, range(0, 256) t(i) GROUP BY i, lo, hi, h""",
)
add(
    "local_curve",
    D + f""",
pt AS (SELECT 0 AS g, {rstep("Sum_Press_Delta", 20)} AS x, {RAIN_SHARE} AS y FROM e2e GROUP BY 2),{LOCAL}""",
    f"SELECT {r6('a')} AS Evt_Press_chng, {r6('fit')} AS fit FROM fits WHERE i >= 0",
)
