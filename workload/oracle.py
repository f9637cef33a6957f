"""The registered queries as SQL over the same tables.

The decomposition has no practical SQL form; it is tested against brute force instead.
"""

from __future__ import annotations

import math

from gaugeline.constants import PILOT_BASINS

from .views import GRID, METRIC_BOXES, METRIC_GRID, PLOT, SHAPE

DAYS = "CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE)"


def _by_day(value: str, where: str = "", prefix: str = "") -> str:
    return (f"SELECT '{prefix}' || CAST(user_id AS VARCHAR) AS clave_estacion, CAST(ts AS DATE) AS fecha, "
            f"AVG(value) * 0.028316846592::DOUBLE AS {value} FROM events {where} GROUP BY 1, 2")


def _full(src: str, cols: str, extra: str = "") -> str:
    """Calendar of ``src`` with its columns; body text may add tables after a leading comma."""
    return (f"SELECT c.clave_estacion, c.fecha, {cols} FROM (SELECT clave_estacion{extra}, {DAYS} AS fecha FROM "
            f"(SELECT clave_estacion{extra}, MIN(fecha) AS a, MAX(fecha) AS b FROM {src} GROUP BY ALL)) c "
            f"LEFT JOIN {src} s ON s.clave_estacion = c.clave_estacion AND s.fecha = c.fecha")


def _region(k: str) -> str:
    return f"CASE {k} % 4 WHEN 0 THEN '12' WHEN 1 THEN '18' WHEN 2 THEN '26' ELSE '10' END"


def _km(a1: str, o1: str, a2: str, o2: str) -> str:
    return (f"2 * 6371.0 * ASIN(LEAST(1.0, SQRT(POW(SIN(RADIANS({a2} - {a1}) / 2), 2) + COS(RADIANS({a1})) * "
            f"COS(RADIANS({a2})) * POW(SIN(RADIANS({o2} - {o1}) / 2), 2))))")


def _linear(src: str, v: str, max_gap: int, whole: bool = False) -> str:
    """Straight lines between valid rows, by row position."""
    limit = f"np - pp - 1 <= {max_gap}" if whole else f"rn - pp <= {max_gap}"
    return f"""
SELECT clave_estacion, fecha,
  CASE WHEN {v} IS NULL AND pp IS NOT NULL AND np IS NOT NULL AND {limit}
       THEN pv + (nv - pv) / CAST(np - pp AS DOUBLE) * (rn - pp) ELSE {v} END AS {v},
  CASE WHEN {v} IS NULL AND pp IS NOT NULL AND np IS NOT NULL AND {limit} THEN 1 ELSE 0 END AS filled
FROM (SELECT *, LAST_VALUE(CASE WHEN {v} IS NOT NULL THEN rn END IGNORE NULLS) OVER back AS pp,
        LAST_VALUE({v} IGNORE NULLS) OVER back AS pv,
        FIRST_VALUE(CASE WHEN {v} IS NOT NULL THEN rn END IGNORE NULLS) OVER ahead AS np,
        FIRST_VALUE({v} IGNORE NULLS) OVER ahead AS nv
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY clave_estacion ORDER BY fecha) AS rn FROM {src})
      WINDOW back AS (PARTITION BY clave_estacion ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             ahead AS (PARTITION BY clave_estacion ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def _corr(a: str, b: str) -> str:
    """Correlation over pairs; NULL when undefined."""
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    x, y = f"CASE WHEN {both} THEN {a} END", f"CASE WHEN {both} THEN {b} END"
    return (f"CASE WHEN STDDEV_POP({x}) > 0 AND STDDEV_POP({y}) > 0 THEN "
            f"COVAR_POP({x}, {y}) / (STDDEV_POP({x}) * STDDEV_POP({y})) END")


FLOW_V = "CASE WHEN o_orderkey % 997 = 0 THEN o_totalprice / 50.0 ELSE o_totalprice / 1000.0 END"

CTE = {
    "daily": _by_day("v"),
    "daily_full": _full("daily", "s.v"),
    "hydro": "SELECT *, 'SIH' AS fuente, 0 AS calidad FROM (" + _by_day(
        "gasto_medio_m3s", "WHERE event_type IN ('purchase', 'click')") + ")",
    "hydro_full": _full("hydro", "s.gasto_medio_m3s, 'SIH' AS fuente, s.calidad"),
    "climate": _by_day("precip_mm", "WHERE event_type = 'view'", "C"),
    "climate_full": _full("climate", "s.precip_mm"),
    "source_b": _by_day("gasto_medio_m3s", "WHERE event_type = 'signup'"),
    "flow": f"""SELECT 'N' || CAST(c_nationkey AS VARCHAR) AS clave_estacion, CAST(o_orderdate AS DATE) AS fecha,
        AVG({FLOW_V}) * 0.028316846592::DOUBLE - 0.6::DOUBLE AS gasto_medio_m3s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "flow_full": _full("flow", "s.gasto_medio_m3s"),
    "monthly": """SELECT 'N' || CAST(c_nationkey AS VARCHAR) AS clave_estacion, CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS mes_inicio,
        SUM(o_totalprice) / 1e6 AS precip_mm, COUNT(*) * 0.1 AS pet_mm FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "catalog": f"""SELECT CAST(user_id AS VARCHAR) AS clave, 'Estacion ' || CAST(user_id AS VARCHAR) AS nombre,
        14 + ((user_id * 37) % 190) / 10.0::DOUBLE AS latitud, -118.5::DOUBLE + ((user_id * 53) % 325) / 10.0::DOUBLE AS longitud,
        CAST((user_id * 13) % 3000 AS DOUBLE) AS altitud, 'E' || CAST(user_id % 32 AS VARCHAR) AS estado,
        {_region('user_id')} AS region_hidrologica FROM (SELECT DISTINCT user_id FROM events)""",
    "climate_catalog": f"""SELECT 'C' || CAST(user_id AS VARCHAR) AS clave,
        14 + ((user_id * 41) % 1900) / 100.0::DOUBLE AS latitud, -118.5::DOUBLE + ((user_id * 59) % 3250) / 100.0::DOUBLE AS longitud,
        {_region('user_id')} AS region_hidrologica FROM (SELECT DISTINCT user_id FROM events)""",
    "nearest": f"""SELECT *, ROW_NUMBER() OVER (PARTITION BY clave ORDER BY dist_km, vecino) AS orden FROM (
        SELECT h.clave, c.clave AS vecino, {_km('h.latitud', 'h.longitud', 'c.latitud', 'c.longitud')} AS dist_km
        FROM catalog h CROSS JOIN climate_catalog c)""",
    "coverage": """SELECT clave_estacion, COUNT(gasto_medio_m3s) AS n_obs, 30 AS dias_periodo, COUNT(gasto_medio_m3s) / 30.0::DOUBLE AS cobertura,
        MIN(fecha) AS inicio, MAX(fecha) AS fin FROM hydro WHERE fecha BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' GROUP BY 1""",
    "hydro_scored": """SELECT c.*, COALESCE(v.cobertura, 0.0) AS cobertura FROM catalog c LEFT JOIN coverage v ON v.clave_estacion = c.clave
        WHERE region_hidrologica IN ('12', '18', '26')""",
    "climate_selected": """SELECT c.*, COALESCE(v.cobertura, 0.0) AS cobertura FROM climate_catalog c LEFT JOIN
        (SELECT clave_estacion, COUNT(precip_mm) / 30.0::DOUBLE AS cobertura FROM climate
         WHERE fecha BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' GROUP BY 1) v ON v.clave_estacion = c.clave
        WHERE region_hidrologica IN ('12', '18', '26') AND COALESCE(v.cobertura, 0.0) >= 0.20""",
    "selected_lists": f"""SELECT clave, STRING_AGG(vecino, ',' ORDER BY orden) AS vecinos_clima FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY clave ORDER BY dist_km, vecino) AS orden FROM (
          SELECT h.clave, c.clave AS vecino, {_km('h.latitud', 'h.longitud', 'c.latitud', 'c.longitud')} AS dist_km
          FROM hydro_scored h CROSS JOIN climate_selected c)) WHERE orden <= 3 GROUP BY 1""",
    "idw": """SELECT n.clave AS clave_estacion, s.fecha,
        SUM(CASE WHEN s.precip_mm IS NOT NULL THEN s.precip_mm * w END) / SUM(CASE WHEN s.precip_mm IS NOT NULL THEN w END) AS idw
        FROM (SELECT *, CASE WHEN dist_km > 0 THEN 1 / POW(dist_km, 2) ELSE 1e12 END AS w FROM nearest WHERE orden <= 3) n
        JOIN climate s ON s.clave_estacion = n.vecino GROUP BY 1, 2""",
    "features_raw": """SELECT h.clave_estacion, h.fecha, h.fuente, h.calidad, h.gasto_medio_m3s, i.idw AS precip_idw_mm,
        LAG(h.gasto_medio_m3s, 1) OVER w AS gasto_medio_m3s_lag1, LAG(h.gasto_medio_m3s, 3) OVER w AS gasto_medio_m3s_lag3,
        LAG(h.gasto_medio_m3s, 7) OVER w AS gasto_medio_m3s_lag7, LAG(h.gasto_medio_m3s, 14) OVER w AS gasto_medio_m3s_lag14,
        LAG(h.gasto_medio_m3s, 30) OVER w AS gasto_medio_m3s_lag30,
        CASE WHEN COUNT(h.gasto_medio_m3s) OVER w7 >= 3 THEN AVG(h.gasto_medio_m3s) OVER w7 END AS gasto_medio_m3s_ma7,
        CASE WHEN COUNT(h.gasto_medio_m3s) OVER w30 >= 15 THEN AVG(h.gasto_medio_m3s) OVER w30 END AS gasto_medio_m3s_ma30
        FROM hydro_full h LEFT JOIN idw i ON i.clave_estacion = h.clave_estacion AND i.fecha = h.fecha
        WINDOW w AS (PARTITION BY h.clave_estacion ORDER BY h.fecha),
          w7 AS (PARTITION BY h.clave_estacion ORDER BY h.fecha ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
          w30 AS (PARTITION BY h.clave_estacion ORDER BY h.fecha ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
    "flow_limits": "SELECT clave_estacion, QUANTILE_CONT(gasto_medio_m3s, 0.999) AS q999 FROM flow GROUP BY 1",
    "flow_full_limits": "SELECT clave_estacion, QUANTILE_CONT(gasto_medio_m3s, 0.999) AS q999 FROM flow_full GROUP BY 1",
    "canonical": f"""SELECT l.clave_estacion, l.fecha, l.gasto_medio_m3s, 'SIH' AS fuente,
        CASE WHEN f.gasto_medio_m3s < 0 OR f.gasto_medio_m3s > 3 * q.q999 THEN 2 WHEN l.filled = 1 THEN 1 ELSE 0 END AS calidad,
        CAST(YEAR(l.fecha) AS INTEGER) AS anio
        FROM ({_linear('flow_full', 'gasto_medio_m3s', 7)}) l JOIN flow_full f USING (clave_estacion, fecha)
        JOIN flow_full_limits q USING (clave_estacion)""",
    "national": """SELECT p.fecha, p.v AS a, q.v AS b, ROW_NUMBER() OVER (ORDER BY p.fecha) AS rn FROM
        (SELECT fecha, AVG(precip_mm) AS v FROM climate WHERE precip_mm IS NOT NULL GROUP BY 1) p JOIN
        (SELECT fecha, AVG(gasto_medio_m3s) AS v FROM hydro WHERE gasto_medio_m3s IS NOT NULL GROUP BY 1) q USING (fecha)""",
    "national_corr": f"""SELECT lag, {_corr('x.a', 'y.b')} AS corr, MAX(n) AS n_fechas
        FROM (SELECT CAST(unnest(range(16)) AS INTEGER) AS lag, (SELECT COUNT(*) FROM national) AS n)
        CROSS JOIN national y LEFT JOIN national x ON x.rn = y.rn - lag WHERE n >= 30 GROUP BY 1""",
    "px": """SELECT 'A' AS basin, CAST(p_partkey // 40 AS INTEGER) AS "row", CAST(p_partkey % 40 AS INTEGER) AS col,
        p_retailprice + p_size * 0.2::DOUBLE AS z FROM part""",
    "grids": """SELECT * FROM px UNION ALL SELECT 'B', CAST(s_suppkey // 3 AS INTEGER), CAST(s_suppkey % 3 AS INTEGER),
        s_suppkey * 1.7::DOUBLE + s_nationkey FROM supplier""",
    "steps": "SELECT * FROM (VALUES (-1,-1), (-1,0), (-1,1), (0,-1), (0,1), (1,-1), (1,0), (1,1)) t(dr, dc)",
    "pointer": f"""SELECT p.basin, p."row", p.col, p.z, b.to_row, b.to_col FROM px p LEFT JOIN (
        SELECT * FROM (SELECT p.basin, p."row", p.col, n."row" AS to_row, n.col AS to_col, ROW_NUMBER() OVER (
            PARTITION BY p.basin, p."row", p.col
            ORDER BY (p.z - n.z) / (CASE WHEN dr <> 0 AND dc <> 0 THEN {math.sqrt(2)!r}::DOUBLE ELSE 1.0::DOUBLE END) DESC, dr, dc) AS k
          FROM px p CROSS JOIN steps JOIN px n ON n.basin = p.basin AND n."row" = p."row" + dr AND n.col = p.col + dc
          WHERE n.z < p.z) WHERE k = 1) b ON b.basin = p.basin AND b."row" = p."row" AND b.col = p.col""",
    "walk": """SELECT basin, "row" AS r0, col AS c0, "row", col, to_row, to_col FROM pointer
        UNION ALL SELECT w.basin, w.r0, w.c0, p."row", p.col, p.to_row, p.to_col FROM walk w JOIN pointer p
          ON p.basin = w.basin AND p."row" = w.to_row AND p.col = w.to_col""",
    "acc": """SELECT basin, "row", col, COUNT(*) AS acc FROM walk GROUP BY ALL""",
    "outlets": """SELECT 'S' || LPAD(CAST(s_suppkey AS VARCHAR), 6, '0') AS clave, 'A' AS basin,
        CAST((s_suppkey * 19) // 40 AS INTEGER) AS "row", CAST((s_suppkey * 19) % 40 AS INTEGER) AS col FROM supplier""",
    "trail": """SELECT p.basin, p."row" AS r0, p.col AS c0, p.to_row, p.to_col, o.clave FROM pointer p
          LEFT JOIN outlets o ON o.basin = p.basin AND o."row" = p."row" AND o.col = p.col
        UNION ALL SELECT w.basin, w.r0, w.c0, p.to_row, p.to_col, o.clave FROM trail w
          JOIN pointer p ON p.basin = w.basin AND p."row" = w.to_row AND p.col = w.to_col
          LEFT JOIN outlets o ON o.basin = p.basin AND o."row" = p."row" AND o.col = p.col WHERE w.clave IS NULL""",
    "sheds": """SELECT basin, r0 AS "row", c0 AS col, MAX(clave) AS clave FROM trail GROUP BY ALL""",
    "tiles": """SELECT 'tile_' || CAST(l_linenumber AS VARCHAR) AS path, 'A' AS basin, CAST(l_partkey // 40 AS INTEGER) AS "row",
        CAST(l_partkey % 40 AS INTEGER) AS col, AVG(l_extendedprice / 1000.0) * (1200.0::DOUBLE / 3937.0::DOUBLE) AS z FROM lineitem GROUP BY ALL""",
    "boxes0": """SELECT s_suppkey, s_name, s_nationkey, -118.5::DOUBLE + ((s_suppkey * 53) % 325) / 10.0::DOUBLE - 0.95::DOUBLE AS x0,
        14 + ((s_suppkey * 37) % 190) / 10.0::DOUBLE - 0.95::DOUBLE AS y0 FROM supplier""",
    "season_flow": """SELECT CASE WHEN MONTH(fecha) BETWEEN 5 AND 10 THEN 'lluviosa' ELSE 'seca' END AS temporada, gasto_medio_m3s AS v FROM flow""",
    "hydro_cat": """SELECT h.*, c.latitud, c.longitud, c.region_hidrologica, c.estado FROM hydro h LEFT JOIN catalog c ON c.clave = h.clave_estacion""",
    "estado_boxes": """SELECT estado, MIN(longitud) AS a1, MIN(latitud) AS b1, MAX(longitud) AS a2, MAX(latitud) AS b2 FROM catalog GROUP BY 1""",
}
CTE["pointer_c"] = "SELECT * FROM pointer WHERE col < 20"
CTE["outlets_c"] = "SELECT * FROM outlets WHERE col < 20"
for _name in ("trail", "sheds"):
    CTE[f"{_name}_c"] = CTE[_name].replace("pointer", "pointer_c").replace("trail", "trail_c").replace("outlets", "outlets_c")


# Breadth-first search: a pixel keeps the distance at which it is met first.
_BY_PIXEL = '{0}(basin, "row", col, z, dist) USING KEY (basin, "row", col)'


def _nearest(name: str, start: str) -> str:
    return f"""{start} UNION SELECT n.basin, n."row", n.col, n.z, t.dist + 1 FROM {name} t JOIN near_f a ON a.basin = t.basin AND a."row" = t."row" AND a.col = t.col
        JOIN still_f n ON n.basin = a.basin AND n."row" = a.nr AND n.col = a.nc
        WHERE a.nz = t.z AND NOT EXISTS (SELECT 1 FROM recurring.{name} k WHERE k.basin = n.basin AND k."row" = n."row" AND k.col = n.col)"""


_LEVEL = 'EXISTS (SELECT 1 FROM near_f a WHERE a.basin = p.basin AND a."row" = p."row" AND a.col = p.col AND a.nz {} p.z)'
CTE |= {
    "pxf": 'SELECT basin, "row", col, FLOOR(z / 12) AS z FROM px',
    "pointer_f": CTE["pointer"].replace("px p", "pxf p").replace("px n", "pxf n"),
    "near_f": """SELECT p.basin, p."row", p.col, n."row" AS nr, n.col AS nc, n.z AS nz, dr, dc FROM pxf p CROSS JOIN steps
        JOIN pxf n ON n.basin = p.basin AND n."row" = p."row" + dr AND n.col = p.col + dc""",
    "still_f": f"SELECT * FROM pointer_f p WHERE to_row IS NULL AND {_LEVEL.format('=')}",
    "low_f": _nearest("low_f", f'SELECT basin, "row", col, z, 0 FROM pointer_f p WHERE to_row IS NOT NULL AND {_LEVEL.format("=")}'),
    "high_f": _nearest("high_f", f'SELECT basin, "row", col, z, 1 FROM still_f p WHERE {_LEVEL.format(">")}'),
    "slope_f": """SELECT l.basin, l."row", l.col, l.z, CASE WHEN l.dist = 0 THEN -1e12 ELSE 2 * l.dist - COALESCE(h.dist, 0) END AS v
        FROM low_f l LEFT JOIN high_f h ON h.basin = l.basin AND h."row" = l."row" AND h.col = l.col""",
    "pointer_flat": """SELECT p.basin, p."row", p.col, p.z, COALESCE(p.to_row, f.nr) AS to_row, COALESCE(p.to_col, f.nc) AS to_col FROM pointer_f p LEFT JOIN (
        SELECT s.basin, s."row", s.col, a.nr, a.nc, ROW_NUMBER() OVER (PARTITION BY s.basin, s."row", s.col ORDER BY n.v, a.dr, a.dc) AS k
        FROM slope_f s JOIN near_f a ON a.basin = s.basin AND a."row" = s."row" AND a.col = s.col
        JOIN slope_f n ON n.basin = a.basin AND n."row" = a.nr AND n.col = a.nc AND n.z = s.z WHERE s.v > -1e12) f
        ON f.k = 1 AND f.basin = p.basin AND f."row" = p."row" AND f.col = p.col""",
    **{f"{n}_f": CTE[n].replace(" pointer p", " pointer_flat p").replace("FROM pointer\n", "FROM pointer_flat\n").replace("FROM walk", "FROM walk_f")
       .replace("FROM trail", "FROM trail_f") for n in ("walk", "acc", "trail", "sheds")},
}
_HEAD = {n: _BY_PIXEL.format(n) for n in ("low_f", "high_f")}


def q(names: str, body: str) -> str:
    parts = [f"{_HEAD.get(n, n)} AS ({CTE[n]})" for n in names.split()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body


def r6(*cols: str) -> str:
    return ", ".join(f"ROUND({c}, 6) + 0.0 AS {c.split('.')[-1]}" for c in cols)


FLATS = "px pxf steps pointer_f near_f still_f low_f high_f slope_f pointer_flat"
KEY = "clave_estacion, CAST(fecha AS VARCHAR) AS fecha"
KNN = "catalog climate_catalog nearest"
SEL = "hydro climate catalog climate_catalog coverage hydro_scored climate_selected selected_lists"
FEATURES = ("precip_idw_mm", *[f"gasto_medio_m3s{x}" for x in ("", "_lag1", "_lag3", "_lag7", "_lag14", "_lag30", "_ma7", "_ma30")])
FEAT = f"hydro hydro_full climate {KNN} idw features_raw"


def _z(c: str) -> str:
    sd = f"STDDEV_SAMP({c}) OVER (PARTITION BY clave_estacion)"
    return (f"ROUND(({c} - AVG({c}) OVER (PARTITION BY clave_estacion)) / (CASE WHEN {sd} = 0 THEN 1.0 ELSE {sd} END), 6) + 0.0 AS {c}")


def _spi(value: str, name: str) -> str:
    return f"""SELECT clave_estacion, CAST(mes_inicio AS VARCHAR) AS mes_inicio,
  ROUND((s - AVG(s) OVER p) / STDDEV_SAMP(s) OVER p, 6) + 0.0 AS {name} FROM (
    SELECT *, CASE WHEN COUNT({value}) OVER w = 3 THEN SUM({value}) OVER w END AS s FROM monthly
    WINDOW w AS (PARTITION BY clave_estacion ORDER BY mes_inicio ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
  WINDOW p AS (PARTITION BY clave_estacion)"""


def _lcc(lon: str, lat: str) -> tuple[str, str]:
    """Lambert conformal conic, Mexico, with the constants worked out in SQL terms here."""
    f = 1 / 298.257222101
    e = math.sqrt(f * (2 - f))
    m = lambda p: math.cos(p) / math.sqrt(1 - e * e * math.sin(p) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    p0, p1, p2 = map(math.radians, (12.0, 17.5, 29.5))
    n = math.log(m(p1) / m(p2)) / math.log(t(p1) / t(p2))
    big = 6378137.0 * m(p1) / (n * t(p1) ** n)
    phi = f"RADIANS({lat})"
    tt = f"(TAN({math.pi / 4!r} - {phi} / 2) / POW((1 - {e!r} * SIN({phi})) / (1 + {e!r} * SIN({phi})), {e / 2!r}))"
    rho = f"({big!r} * POW({tt}, {n!r}))"
    th = f"({n!r} * RADIANS({lon} + 102.0))"
    return f"(2500000.0 + {rho} * SIN({th}))", f"({big * t(p0) ** n!r} - {rho} * COS({th}))"


X, Y = _lcc("longitud", "latitud")
VX, VY = _lcc("x", "y")


def _lonlat(x: str, y: str) -> tuple[str, str]:
    """The inverse of ``_lcc``, latitude by seven nested steps."""
    f = 1 / 298.257222101
    e = math.sqrt(f * (2 - f))
    m = lambda p: math.cos(p) / math.sqrt(1 - e * e * math.sin(p) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    p0, p1, p2 = map(math.radians, (12.0, 17.5, 29.5))
    n = math.log(m(p1) / m(p2)) / math.log(t(p1) / t(p2))
    big = 6378137.0 * m(p1) / (n * t(p1) ** n)
    dx, dy = f"({x} - 2500000.0)", f"({big * t(p0) ** n!r} - {y})"
    ts = f"POW(SQRT({dx} * {dx} + {dy} * {dy}) / {big!r}, {1 / n!r})"
    lat = (f"DEGREES(list_reduce([PI() / 2 - 2 * ATAN({ts}), 1, 2, 3, 4, 5, 6, 7], lambda p, i: "
           f"PI() / 2 - 2 * ATAN({ts} * POW((1 - {e!r} * SIN(p)) / (1 + {e!r} * SIN(p)), {e / 2!r}))))")
    return f"(-102.0 + DEGREES(ATAN2({dx}, {dy})) / {n!r})", lat


def _edge_points(src: str, a: str = "a", b: str = "b", c: str = "c", d: str = "d") -> str:
    """Points of the edges of a box: corners and 21 between them."""
    return (f"SELECT *, unnest([{{'x': {a} + f * ({c} - {a}), 'y': {b}}}, {{'x': {a} + f * ({c} - {a}), 'y': {d}}}, {{'x': {a}, 'y': {b} + f * ({d} - {b})}}, "
            f"{{'x': {c}, 'y': {b} + f * ({d} - {b})}}]) AS v FROM (SELECT *, unnest(range(23)) / 22.0::DOUBLE AS f FROM {src})")


def _vertices(rings) -> str:
    return ", ".join(f"({r}, {k}, {dx}::DOUBLE, {dy}::DOUBLE)" for r, ring in enumerate(rings) for k, (dx, dy) in enumerate(ring))


def _area_of_rings() -> str:
    """Shoelace sum of each ring about its first vertex; the hole counts negative."""
    return f""", v AS (SELECT s_name, r, k, x0 + dx AS x, y0 + dy AS y FROM boxes0 CROSS JOIN (VALUES {_vertices(SHAPE)}) t(r, k, dx, dy)),
        m AS (SELECT s_name, r, k, {VX} AS e, {VY} AS n FROM v),
        w AS (SELECT s_name, r, e, n, LEAD(e) OVER o AS e2, LEAD(n) OVER o AS n2, FIRST_VALUE(e) OVER o AS e0, FIRST_VALUE(n) OVER o AS n0
              FROM m WINDOW o AS (PARTITION BY s_name, r ORDER BY k)),
        a AS (SELECT s_name, r, ABS(SUM((e - e0) * (COALESCE(n2, n0) - n0) - (COALESCE(e2, e0) - e0) * (n - n0))) / 2 / 1e6 AS a FROM w GROUP BY 1, 2)"""


def _zonal() -> str:
    """Every pixel against every polygon: inside where an odd number of edges crosses its row to its left."""
    w, n, c = GRID
    return f""", o AS (SELECT 'S' || LPAD(CAST(s_suppkey AS VARCHAR), 6, '0') AS clave, -100.4893::DOUBLE + ((s_suppkey * 7) % 30) * 0.03::DOUBLE AS x0,
          19.9887::DOUBLE - ((s_suppkey * 11) % 40) * 0.03::DOUBLE AS y0 FROM supplier),
        v AS (SELECT clave, r, k, x0 + dx AS x, y0 + dy AS y FROM o CROSS JOIN (VALUES {_vertices(PLOT)}) t(r, k, dx, dy)),
        g AS (SELECT *, COALESCE(LEAD(x) OVER s, FIRST_VALUE(x) OVER s) AS x2, COALESCE(LEAD(y) OVER s, FIRST_VALUE(y) OVER s) AS y2 FROM v
              WINDOW s AS (PARTITION BY clave, r ORDER BY k)),
        lab AS (SELECT clave, basin, "row", col, z FROM (SELECT *, {n}::DOUBLE - ("row" + 0.5::DOUBLE) * {c}::DOUBLE AS yc, {w}::DOUBLE + (col + 0.5::DOUBLE) * {c}::DOUBLE AS xc FROM px)
              JOIN g ON (y <= yc) <> (y2 <= yc) AND x + (yc - y) / (y2 - y) * (x2 - x) <= xc GROUP BY ALL HAVING COUNT(*) % 2 = 1),
        ext AS (SELECT MIN("row") AS t, MAX("row") AS b, MIN(col) AS l, MAX(col) AS r FROM px),
        sz AS (SELECT * FROM lab),
        e AS (SELECT clave, 'A' AS basin, GREATEST(FLOOR(({n}::DOUBLE - MAX(y)) / {c}::DOUBLE), ANY_VALUE(t)) AS r0, LEAST(CEIL(({n}::DOUBLE - MIN(y)) / {c}::DOUBLE) - 1, ANY_VALUE(b)) AS r1,
              GREATEST(FLOOR((MIN(x) - {w}::DOUBLE) / {c}::DOUBLE), ANY_VALUE(l)) AS c0, LEAST(CEIL((MAX(x) - {w}::DOUBLE) / {c}::DOUBLE) - 1, ANY_VALUE(ext.r)) AS c1 FROM v, ext GROUP BY clave),
        st AS (SELECT clave, COUNT(z) AS celdas, AVG(z) AS zm, AVG(gr) AS gm FROM (
              SELECT s.clave, NULL AS z, DEGREES(ATAN(SQRT(POW((d.z - s.z) / 2, 2) + POW((r.z - l.z) / 2, 2)))) AS gr FROM sz s
              {_nb('d', 2, 0)} {_nb('l', 1, -1)} {_nb('r', 1, 1)} {_nb('h', 1, 0)} WHERE h.z IS NULL AND d.z IS NOT NULL AND l.z IS NOT NULL AND r.z IS NOT NULL
              UNION ALL
              SELECT s.clave, s.z, DEGREES(ATAN(SQRT(POW({_GRAD_Y}, 2) + POW({_GRAD_X}, 2)))) AS gr FROM sz s JOIN e USING (clave, basin)
              {_nb('u', -1, 0)} {_nb('d', 1, 0)} {_nb('l', 0, -1)} {_nb('r', 0, 1)}) GROUP BY 1),
        m AS (SELECT clave, r, k, {VX} AS e, {VY} AS n FROM v),
        w AS (SELECT clave, r, e, n, LEAD(e) OVER o AS e2, LEAD(n) OVER o AS n2, FIRST_VALUE(e) OVER o AS e0, FIRST_VALUE(n) OVER o AS n0
              FROM m WINDOW o AS (PARTITION BY clave, r ORDER BY k)),
        a AS (SELECT clave, SUM(CASE WHEN r = 1 THEN -a ELSE a END) AS a FROM (SELECT clave, r,
              ABS(SUM((e - e0) * (COALESCE(n2, n0) - n0) - (COALESCE(e2, e0) - e0) * (n - n0))) / 2 / 1e6 AS a FROM w GROUP BY 1, 2) GROUP BY 1)
        SELECT clave, COALESCE(celdas, 0) AS celdas, ROUND(a, 6) AS area_km2, ROUND(zm, 6) AS elevacion_media, ROUND(gm, 6) AS pendiente_media FROM a LEFT JOIN st USING (clave)"""


def _clip_projected() -> str:
    w, n, c = METRIC_GRID
    boxes = ", ".join(f"('{b}', {', '.join(f'{x}::DOUBLE' for x in v)})" for b, *v in METRIC_BOXES)
    ex, ny = _lcc("v.x", "v.y")
    return f""", bx AS (SELECT * FROM (VALUES {boxes}) t(basin, a, b, c, d)), pt AS ({_edge_points('bx')}),
        bd AS (SELECT basin, MIN({ex}) AS x1, MAX({ex}) AS x2, MIN({ny}) AS y1, MAX({ny}) AS y2 FROM pt GROUP BY 1)
        SELECT basin, "row", col, ROUND(z, 6) AS z FROM grids JOIN bd USING (basin)
        WHERE {w}::DOUBLE + (col + 0.5::DOUBLE) * {c}::DOUBLE BETWEEN x1 AND x2 AND {n}::DOUBLE - ("row" + 0.5::DOUBLE) * {c}::DOUBLE BETWEEN y1 AND y2"""


def _tiles_projected() -> str:
    lon, lat = _lonlat("v.x", "v.y")
    return f""", mt AS (SELECT s_name, 1200000.0::DOUBLE + (s_suppkey * 53 % 325) * 9000.0::DOUBLE AS a, 400000.0::DOUBLE + (s_suppkey * 37 % 190) * 9000.0::DOUBLE AS b FROM supplier),
        mb AS (SELECT *, a + 150000 AS c, b + 150000 AS d FROM mt), pt AS ({_edge_points('mb')}),
        gb AS (SELECT s_name, MIN({lon}) AS x1, MAX({lon}) AS x2, MIN({lat}) AS y1, MAX({lat}) AS y2 FROM pt GROUP BY 1)
        SELECT s_name AS tile, estado AS cuenca FROM gb JOIN estado_boxes ON NOT (x2 < a1 OR x1 > a2 OR y2 < b1 OR y1 > b2)"""


def _mosaic_aligned() -> str:
    """From the target: each cell's centre is looked up in every tile."""
    return """, fr AS (SELECT DISTINCT 'tile_' || CAST(l_linenumber AS VARCHAR) AS path, -100.5::DOUBLE + (l_linenumber - 1) * 0.0413::DOUBLE AS west,
          20.0::DOUBLE + (l_linenumber - 1) * 0.0277::DOUBLE AS north, 0.03::DOUBLE * (1 + (l_linenumber % 3) * 0.5::DOUBLE) AS cell FROM lineitem),
        tg AS (SELECT MIN(west) AS w, MAX(north) AS n, ARG_MIN(cell, path) AS c FROM fr),
        size AS (SELECT path, MAX("row") + 1 AS h, MAX(col) + 1 AS v FROM tiles GROUP BY 1),
        cells AS (SELECT path, west, north, cell, w, n, c, r, unnest(range(CAST(FLOOR((west - w) / c) AS BIGINT) - 1, CAST(CEIL((west - w + v * cell) / c) AS BIGINT) + 1)) AS k
          FROM (SELECT *, unnest(range(CAST(FLOOR((n - north) / c) AS BIGINT) - 1, CAST(CEIL((n - north + h * cell) / c) AS BIGINT) + 1)) AS r FROM fr JOIN size USING (path), tg)),
        spots AS (SELECT path, r, k, FLOOR((north - (n - (r + 0.5::DOUBLE) * c)) / cell) AS sr, FLOOR((w + (k + 0.5::DOUBLE) * c - west) / cell) AS sc FROM cells)
        SELECT t.basin, CAST(r AS INTEGER) AS "row", CAST(k AS INTEGER) AS col, ROUND(ARG_MIN(z, spots.path), 6) AS z
        FROM spots JOIN tiles t ON t.path = spots.path AND t."row" = sr AND t.col = sc GROUP BY ALL"""


def _resample(scale: float) -> str:
    """Weights per axis from the definition, target by target."""
    if scale >= 1:
        span = f"LEAST((t + 1) * {scale}, i + 1) - GREATEST(t * {scale}, i)"
    else:
        span = f"1 - ABS((t + 0.5) * {scale} - 0.5 - i)"
    axis = (f"SELECT basin, t, i, w FROM (SELECT basin, t, i, CAST({span} AS DOUBLE) AS w FROM (SELECT basin, t, unnest(range({{m}})) AS i FROM "
            f"(SELECT basin, {{m}}, unnest(range(CAST(FLOOR({{m}} / {scale}) AS BIGINT))) AS t FROM sz))) WHERE w > 0")
    return (f", sz AS (SELECT basin, MAX(\"row\") + 1 AS h, MAX(col) + 1 AS v FROM grids GROUP BY 1) "
            f"SELECT basin, CAST(r.t AS INTEGER) AS \"row\", CAST(c.t AS INTEGER) AS col, ROUND(SUM(r.w * c.w * z) / SUM(r.w * c.w), 6) AS z "
            f"FROM grids JOIN ({axis.format(m='h')}) r USING (basin) JOIN ({axis.format(m='v')}) c USING (basin) "
            f"WHERE r.i = grids.\"row\" AND c.i = grids.col GROUP BY ALL")


# Not-a-knot cubic through the valid rows of each station: the tridiagonal system for the
# second derivatives, swept forwards and backwards by recursion over the points.
CTE |= {
    "lin": _linear("climate_full", "precip_mm", 7),
    "numbered": "SELECT *, ROW_NUMBER() OVER (PARTITION BY clave_estacion ORDER BY fecha) AS rn FROM climate_full",
    "pts": """SELECT *, LEAD(x) OVER w - x AS h, (LEAD(y) OVER w - y) / (LEAD(x) OVER w - x) AS d FROM (
        SELECT clave_estacion AS st, CAST(rn AS DOUBLE) AS x, precip_mm AS y, ROW_NUMBER() OVER (PARTITION BY clave_estacion ORDER BY rn) AS i,
          COUNT(*) OVER (PARTITION BY clave_estacion) AS n FROM numbered WHERE precip_mm IS NOT NULL)
        WHERE n >= 4 WINDOW w AS (PARTITION BY st ORDER BY i)""",
    "sys": """SELECT b.st, b.i, b.n, a.h - CASE WHEN b.i = b.n - 1 THEN b.h * b.h / a.h ELSE 0 END AS lo,
        2 * (a.h + b.h) + CASE WHEN b.i = 2 THEN a.h * (1 + a.h / b.h) ELSE 0 END
          + CASE WHEN b.i = b.n - 1 THEN b.h * (1 + b.h / a.h) ELSE 0 END AS di,
        b.h - CASE WHEN b.i = 2 THEN a.h * a.h / b.h ELSE 0 END AS up, 6 * (b.d - a.d) AS r
        FROM pts a JOIN pts b ON b.st = a.st AND b.i = a.i + 1 WHERE b.i < b.n""",
    "fwd": """SELECT st, i, n, up / di AS c, r / di AS g FROM sys WHERE i = 2
        UNION ALL SELECT s.st, s.i, s.n, s.up / (s.di - s.lo * f.c), (s.r - s.lo * f.g) / (s.di - s.lo * f.c)
        FROM fwd f JOIN sys s ON s.st = f.st AND s.i = f.i + 1""",
    "bwd": """SELECT st, i, g AS m FROM fwd WHERE i = n - 1
        UNION ALL SELECT f.st, f.i, f.g - f.c * b.m FROM bwd b JOIN fwd f ON f.st = b.st AND f.i = b.i - 1""",
    "curve": """SELECT * FROM bwd
        UNION ALL SELECT a.st, 1, (1 + a.h / b.h) * m2.m - a.h / b.h * m3.m FROM pts a JOIN pts b ON b.st = a.st AND a.i = 1 AND b.i = 2
          JOIN bwd m2 ON m2.st = a.st AND m2.i = 2 JOIN bwd m3 ON m3.st = a.st AND m3.i = 3
        UNION ALL SELECT a.st, a.n, (1 + b.h / a.h) * m2.m - b.h / a.h * m3.m FROM pts a JOIN pts b ON b.st = a.st AND a.i = a.n - 2 AND b.i = a.n - 1
          JOIN bwd m2 ON m2.st = a.st AND m2.i = a.n - 1 JOIN bwd m3 ON m3.st = a.st AND m3.i = a.n - 2""",
    "cubic": """SELECT k.clave_estacion, k.fecha,
        (c1.m * POW(b.x - k.rn, 3) + c2.m * POW(k.rn - a.x, 3)) / (6 * a.h) + (a.y / a.h - c1.m * a.h / 6) * (b.x - k.rn)
          + (b.y / a.h - c2.m * a.h / 6) * (k.rn - a.x) AS v
        FROM numbered k JOIN pts a ON a.st = k.clave_estacion JOIN pts b ON b.st = a.st AND b.i = a.i + 1 AND k.rn > a.x AND k.rn < b.x
        JOIN curve c1 ON c1.st = a.st AND c1.i = a.i JOIN curve c2 ON c2.st = b.st AND c2.i = b.i""",
}

# The same over the flow series.
_FLOW = (("climate_full", "flow_full"), ("precip_mm", "gasto_medio_m3s"), ("numbered", "numbered_f"), ("pts", "pts_f"), ("sys", "sys_f"),
         ("fwd", "fwd_f"), ("bwd", "bwd_f"), ("curve", "curve_f"))
for _name in ("numbered", "pts", "sys", "fwd", "bwd", "curve", "cubic"):
    _sql = CTE[_name]
    for _a, _b in _FLOW:
        _sql = _sql.replace(_a, _b)
    CTE[f"{_name}_f"] = _sql

# The gamma index: both distribution functions as sums of positive terms, the normal quantile by bisection.
_GAMMA = """, s AS (SELECT *, CASE WHEN COUNT(precip_mm) OVER w = 3 THEN SUM(precip_mm) OVER w END AS s FROM monthly
    WINDOW w AS (PARTITION BY clave_estacion ORDER BY mes_inicio ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
  m AS (SELECT *, AVG(CASE WHEN s > 0 THEN s END) OVER p AS mean, LN(AVG(CASE WHEN s > 0 THEN s END) OVER p) - AVG(CASE WHEN s > 0 THEN LN(s) END) OVER p AS k,
      COUNT(CASE WHEN s = 0 THEN 1 END) OVER p / NULLIF(COUNT(s) OVER p, 0) AS zero FROM s WINDOW p AS (PARTITION BY clave_estacion, MONTH(mes_inicio))),
  g AS (SELECT clave_estacion, mes_inicio, a, s * a / mean AS x, zero FROM
      (SELECT *, CASE WHEN k > 0 THEN (1 + SQRT(1 + 4 * k / 3)) / (4 * k) END AS a FROM m)),
  r AS (SELECT *, CASE WHEN x <= 0 THEN 0 ELSE list_sum(list_transform(range(CAST(CEIL(GREATEST(x - a, 0) + 12 * SQRT(x + 40) + 40) AS BIGINT)),
      lambda n: EXP((a + n) * LN(x) - x - LGAMMA(a + n + 1)))) END AS cdf FROM g),
  b AS (SELECT clave_estacion, mes_inicio, zero + (1 - zero) * cdf AS p, -8.0::DOUBLE AS low, 8.0::DOUBLE AS high, 0 AS step FROM r
      UNION ALL SELECT clave_estacion, mes_inicio, p, CASE WHEN f < p THEN mid ELSE low END, CASE WHEN f < p THEN high ELSE mid END, step + 1 FROM (
        SELECT *, CASE WHEN mid < 0 THEN 0.5 - half ELSE 0.5 + half END AS f FROM (
          SELECT *, CASE WHEN mid = 0 THEN 0 ELSE list_sum(list_transform(range(CAST(CEIL(mid * mid / 2 + 12 * SQRT(mid * mid / 2 + 10)) AS BIGINT)),
            lambda n: EXP((0.5 + n) * LN(mid * mid / 2) - mid * mid / 2 - LGAMMA(n + 1.5)))) / 2 END AS half
          FROM (SELECT *, (low + high) / 2 AS mid FROM b WHERE step < 52))))
SELECT clave_estacion, CAST(mes_inicio AS VARCHAR) AS mes_inicio, CASE WHEN p IS NOT NULL THEN ROUND(GREATEST(-3.09, LEAST(3.09, (low + high) / 2)), 6) + 0.0 END AS spi3 FROM b WHERE step = 52"""

LIN = ("SELECT {key}, ROUND({v}, 6) + 0.0 AS {v}, filled AS calidad FROM ({sub})")

_PAIRED = f"""SELECT lag, ROUND(AVG(r), 6) + 0.0 AS corr FROM (
  SELECT lag, y.clave_estacion, {_corr('x.p', 'y.g')} AS r FROM (SELECT CAST(unnest(range(11)) AS INTEGER) AS lag)
  CROSS JOIN j y LEFT JOIN j x ON x.clave_estacion = y.clave_estacion AND x.rn = y.rn - lag GROUP BY 1, 2) GROUP BY 1"""

_BOX_COLS = ("min_lon", "min_lat", "max_lon", "max_lat")


def _bbox(margin: float, by: str = "") -> str:
    agg = (f"ROUND(MIN(longitud) - {margin}::DOUBLE, 6) AS min_lon, ROUND(MIN(latitud) - {margin}::DOUBLE, 6) AS min_lat, "
           f"ROUND(MAX(longitud) + {margin}::DOUBLE, 6) AS max_lon, ROUND(MAX(latitud) + {margin}::DOUBLE, 6) AS max_lat")
    return f"SELECT {by + ', ' if by else ''}{agg} FROM catalog" + (f" GROUP BY {by}" if by else "")


_PILOT = ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for n, _, (a, b, c, d), *_ in PILOT_BASINS)

def _value(v: str) -> str:
    """A value as number where it is one, else as text."""
    return (f"ROUND(TRY_CAST(CAST({v} AS VARCHAR) AS DOUBLE), 6) + 0.0 AS number, "
            f"CASE WHEN TRY_CAST(CAST({v} AS VARCHAR) AS DOUBLE) IS NULL THEN CAST({v} AS VARCHAR) END AS text")


_SERIES_RULES = [
    ("clave_estacion", "str_matches", "clave LIKE 'no valida%'", "clave"), ("gasto_medio_m3s", "ge(0)", "value - 5.0 < 0", "value - 5.0"),
    ("tmax_c", "in_range(-30, 60)", "value NOT BETWEEN -30 AND 60", "value"), ("fuente", "isin", "event_type = 'error'", "'OTRA'"),
    ("calidad", "isin", "event_id % 4 = 3", "event_id % 4"),
]
_MESSY = ("SELECT *, CASE WHEN user_id % 10 = 0 THEN 'no valida ' || CAST(user_id AS VARCHAR) ELSE CAST(user_id AS VARCHAR) END AS clave, "
          "CAST(CAST(ts AS DATE) AS VARCHAR) AS fecha FROM events")
_CAT_MESSY = ("SELECT CASE WHEN c_nationkey = 3 THEN 'llave muy larga' ELSE 'N' || CAST(c_nationkey AS VARCHAR) END AS clave, "
              "CAST(10 + c_custkey % 25 AS DOUBLE) AS latitud, -120.0 + c_custkey % 40 AS longitud, c_acctbal / 10 AS altitud FROM customer")
_CAT_RULES = [("clave", "str_matches", "clave = 'llave muy larga'"), ("latitud", "in_range(14, 33)", "latitud NOT BETWEEN 14 AND 33"),
              ("longitud", "in_range(-118.5, -86)", "longitud NOT BETWEEN -118.5 AND -86"), ("altitud", "ge(-50)", "altitud < -50")]

_GRAD_Y = """CASE WHEN s."row" = e.r0 THEN d.z - s.z WHEN s."row" = e.r1 THEN s.z - u.z ELSE (d.z - u.z) / 2 END"""
_GRAD_X = """CASE WHEN s.col = e.c0 THEN r.z - s.z WHEN s.col = e.c1 THEN s.z - l.z ELSE (r.z - l.z) / 2 END"""


def _nb(alias: str, dr: int, dc: int) -> str:
    return (f"LEFT JOIN sz {alias} ON {alias}.clave = s.clave AND {alias}.basin = s.basin "
            f"AND {alias}.\"row\" = s.\"row\" + ({dr}) AND {alias}.col = s.col + ({dc})")


_BODIES = """SELECT 'raw' AS zone, CAST(c_nationkey AS VARCHAR) AS part, string_agg(c_name || chr(10), '' ORDER BY c_custkey) AS body FROM customer GROUP BY ALL
        UNION ALL SELECT 'processed', CAST(n_regionkey AS VARCHAR), string_agg(n_name || chr(10), '' ORDER BY n_nationkey) FROM nation GROUP BY ALL"""


def _metric(section: str, names: dict[str, str], src: str, key: str = "NULL") -> list[str]:
    return [f"SELECT '{section}' AS section, '{n}' AS name, CAST({key} AS VARCHAR) AS key, CAST({e} AS VARCHAR) AS value {src}"
            for n, e in names.items()]


def _metrics() -> str:
    parts: list[str] = []
    for label, src in (("hidrometricas", "hydro"), ("climatologicas", "climate")):
        parts += _metric("dataset", {"n_estaciones": "COUNT(DISTINCT clave_estacion)", "n_filas": "COUNT(*)",
                                     "fecha_min": "MIN(fecha)", "fecha_max": "MAX(fecha)"}, f"FROM {src}", f"'{label}'")
    parts += _metric("inventario", {"n_estaciones": "COUNT(DISTINCT clave_estacion)"},
                     "FROM hydro_cat GROUP BY region_hidrologica", "region_hidrologica")
    parts += _metric("cobertura", {"n_estaciones_total": "COUNT(*)", "cobertura_media_pct": "AVG(cobertura) * 100",
                                   "estaciones_ge_60pct": "COUNT(*) FILTER (cobertura >= 0.60)",
                                   "estaciones_ge_80pct": "COUNT(*) FILTER (cobertura >= 0.80)"}, "FROM coverage")
    g = "gasto_medio_m3s"
    parts += _metric("describe", {"count": f"COUNT({g})", "mean": f"AVG({g})", "std": f"STDDEV_SAMP({g})", "min": f"MIN({g})",
                                  "p25": f"QUANTILE_CONT({g}, 0.25)", "p50": f"QUANTILE_CONT({g}, 0.5)",
                                  "p75": f"QUANTILE_CONT({g}, 0.75)", "max": f"MAX({g})"}, "FROM hydro")
    season = "CASE WHEN MONTH(fecha) BETWEEN 5 AND 10 THEN 'lluviosa' ELSE 'seca' END"
    parts += _metric("temporada", {"mean": f"ROUND(AVG({g}), 2)", "median": f"ROUND(QUANTILE_CONT({g}, 0.5), 2)",
                                   "max": f"ROUND(MAX({g}), 2)"}, f"FROM hydro GROUP BY {season}", season)
    labels = "(VALUES (0, 'ok'), (1, 'imputed'), (2, 'outlier')) t(q, label) LEFT JOIN hydro ON calidad = q GROUP BY label"
    parts += _metric("calidad", {"n": "COUNT(calidad)", "pct": "COUNT(calidad) * 100.0 / (SELECT COUNT(*) FROM hydro)"},
                     f"FROM {labels}", "label")
    parts += _metric("mapa", {"n_estaciones_geolocalizadas": "COUNT(DISTINCT clave_estacion)"},
                     "FROM hydro_cat WHERE latitud IS NOT NULL AND longitud IS NOT NULL")
    parts += _metric("climatologia_mensual", {"mean": f"AVG({g})", "std": f"STDDEV_SAMP({g})", "count": f"COUNT({g})"},
                     "FROM hydro GROUP BY MONTH(fecha)", "MONTH(fecha)")
    parts += _metric("media_anual", {g: f"AVG({g})"}, "FROM hydro GROUP BY YEAR(fecha)", "YEAR(fecha)")
    parts += _metric("precip_gasto", {"lag_max_correlacion_dias": "ARG_MAX(lag, corr)", "correlacion_max": "MAX(corr)",
                                      "n_fechas_comunes": "MAX(n_fechas)"}, "FROM national_corr")
    parts += _metric("subcuencas", {"n_subcuencas": "COUNT(*)"}, "FROM supplier GROUP BY ROLLUP (s_nationkey)", "COALESCE(CAST(s_nationkey AS VARCHAR), 'total')")
    return ("SELECT section, name, key, ROUND(TRY_CAST(value AS DOUBLE), 6) + 0.0 AS number, "
            "CASE WHEN TRY_CAST(value AS DOUBLE) IS NULL THEN value END AS text FROM (" + " UNION ALL ".join(parts) + ")")


ORACLE = {
    "to_daily": q("daily daily_full", f"SELECT {KEY}, {r6('v')} FROM daily_full"),
    "unique_days": """SELECT CAST(user_id AS VARCHAR) AS clave_estacion, CAST(CAST(ts AS DATE) AS VARCHAR) AS fecha,
        MIN(event_id) AS event_id, ROUND(ARG_MIN(value, event_id), 6) AS value FROM events GROUP BY 1, 2""",
    "replace_sentinels": "SELECT event_id, CASE WHEN event_id % 17 <> 0 AND event_id % 19 <> 0 THEN ROUND(value, 6) END AS value FROM events",
    "flag_outliers": q("flow flow_limits", f"""SELECT {KEY}, {r6('gasto_medio_m3s')},
        CASE WHEN gasto_medio_m3s < 0 OR gasto_medio_m3s > 3 * q999 THEN 2 ELSE 0 END AS calidad FROM flow JOIN flow_limits USING (clave_estacion)"""),
    "outlier_limits": q("flow flow_limits", f"SELECT clave_estacion, {r6('q999')} FROM flow_limits"),
    "impute_linear": q("climate climate_full", LIN.format(key=KEY, v="precip_mm", sub=_linear("climate_full", "precip_mm", 7))),
    "impute_cubic": q("climate climate_full lin numbered pts sys fwd bwd curve cubic", """
        SELECT clave_estacion, CAST(fecha AS VARCHAR) AS fecha, filled AS calidad,
          ROUND(CASE WHEN filled = 1 AND v IS NOT NULL THEN v ELSE precip_mm END, 6) + 0.0 AS precip_mm
        FROM lin LEFT JOIN cubic USING (clave_estacion, fecha)"""),
    "impute_linear_whole": q("climate climate_full", LIN.format(key=KEY, v="precip_mm", sub=_linear("climate_full", "precip_mm", 3, True))),
    "canonical": q("flow flow_full flow_full_limits canonical", f"SELECT {KEY}, {r6('gasto_medio_m3s')}, fuente, calidad, anio FROM canonical"),
    "canonical_cubic": q("flow flow_full flow_full_limits canonical numbered_f pts_f sys_f fwd_f bwd_f curve_f cubic_f", """
        SELECT c.clave_estacion, CAST(c.fecha AS VARCHAR) AS fecha, ROUND(CASE WHEN f.gasto_medio_m3s IS NULL AND c.gasto_medio_m3s IS NOT NULL AND v IS NOT NULL
          THEN v ELSE c.gasto_medio_m3s END, 6) + 0.0 AS gasto_medio_m3s, fuente, calidad, anio
        FROM canonical c JOIN flow_full f USING (clave_estacion, fecha) LEFT JOIN cubic_f v USING (clave_estacion, fecha)"""),
    "canonical_target": q("flow flow_full flow_full_limits canonical", f"SELECT {KEY}, {r6('gasto_medio_m3s')}, fuente, calidad, anio FROM canonical"),
    "canonical_by_station": q("flow flow_full flow_full_limits canonical", f"""SELECT {KEY}, {r6('gasto_medio_m3s')}, ROUND(LAG(gasto_medio_m3s, 1) OVER w, 6) + 0.0 AS gasto_medio_m3s_lag1,
        ROUND(LAG(gasto_medio_m3s, 7) OVER w, 6) + 0.0 AS gasto_medio_m3s_lag7,
        CASE WHEN COUNT(gasto_medio_m3s) OVER a >= 3 THEN ROUND(AVG(gasto_medio_m3s) OVER a, 6) + 0.0 END AS gasto_medio_m3s_ma7
        FROM canonical WINDOW w AS (PARTITION BY clave_estacion ORDER BY fecha), a AS (PARTITION BY clave_estacion ORDER BY fecha ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""),
    "canonical_table": q("flow flow_full flow_full_limits canonical", f"""SELECT {KEY}, {r6('gasto_medio_m3s')}, fuente, calidad, anio
        FROM canonical WHERE fecha BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'"""),
    "validate_series": " UNION ALL ".join(
        f"SELECT clave AS clave_estacion, fecha, '{c}' AS \"column\", '{k}' AS \"check\", {_value(v)} FROM ({_MESSY}) WHERE {w}" for c, k, w, v in _SERIES_RULES),
    "validate_catalog": " UNION ALL ".join(
        [f"SELECT clave, '{c}' AS \"column\", '{k}' AS \"check\", {_value(c)} FROM ({_CAT_MESSY}) WHERE {w}" for c, k, w in _CAT_RULES]
        + [f"SELECT clave, 'clave' AS \"column\", 'unique' AS \"check\", {_value('COUNT(*)')} FROM ({_CAT_MESSY}) GROUP BY clave HAVING COUNT(*) > 1"]),
    "manifest": """SELECT CAST(c_nationkey AS VARCHAR) AS nation, sha256(body) AS sha256, CAST(strlen(body) AS BIGINT) AS bytes FROM (
        SELECT c_nationkey, string_agg(c_name || chr(10), '' ORDER BY c_custkey) AS body FROM customer GROUP BY 1)""",
    "manifest_summary": """SELECT COUNT(DISTINCT c_nationkey) AS n_files, CAST(SUM(strlen(c_name) + 1) AS BIGINT) AS total_bytes FROM customer""",
    "storage_report": """WITH z AS (SELECT CAST(c_nationkey AS VARCHAR) AS zone, CAST(SUM(strlen(c_name) + 1) AS BIGINT) AS bytes FROM customer GROUP BY 1)
        SELECT zone, bytes, bytes AS bytes_no_npz, CAST(NULL AS BOOLEAN) AS over_cap FROM z
        UNION ALL SELECT NULL, CAST(SUM(bytes) AS BIGINT), CAST(COALESCE(SUM(bytes) FILTER (zone IN ('1', '2', '3')), 0) AS BIGINT),
          COALESCE(SUM(bytes) FILTER (zone IN ('1', '2', '3')), 0) / 1e9 > 1e-6 FROM z""",
    "manifest_all": f"""SELECT zone, part, sha256(body) AS sha256, CAST(strlen(body) AS BIGINT) AS bytes FROM ({_BODIES})""",
    "storage_all": f"""WITH z AS (SELECT zone, CAST(SUM(strlen(body)) AS BIGINT) AS bytes FROM ({_BODIES}) GROUP BY 1)
        SELECT zone, bytes, bytes AS bytes_no_npz, CAST(NULL AS BOOLEAN) AS over_cap FROM z
        UNION ALL SELECT NULL, CAST(SUM(bytes) AS BIGINT), CAST(SUM(bytes) AS BIGINT), SUM(bytes) / 1e9 > 1e-6 FROM z""",
    "series_files": q("hydro hydro_full", f"""SELECT {KEY}, CAST(NULL AS DOUBLE) AS nivel_m,
        ROUND(gasto_medio_m3s, 4) + 0.0 AS gasto_medio_m3s FROM hydro_full"""),
    "catalog_file": q("catalog", f"""SELECT clave, nombre, {r6('latitud', 'longitud')}, CASE WHEN altitud <= 2500 THEN altitud END AS altitud,
        estado, region_hidrologica FROM catalog"""),
    "station_set": q("hydro catalog coverage hydro_scored", f"SELECT LPAD(clave, 7, '0') AS clave, nombre, {r6('latitud', 'cobertura')} FROM hydro_scored"),
    "mixed_dates": "SELECT event_id, CASE WHEN event_id % 7 < 6 THEN CAST(CAST(ts AS DATE) AS VARCHAR) END AS fecha FROM events",
    "parse_roundtrip": q("hydro hydro_full", f"""SELECT {KEY}, CAST(NULL AS DOUBLE) AS nivel_m,
        ROUND(gasto_medio_m3s, 4) + 0.0 AS gasto_medio_m3s FROM hydro_full"""),
    "catalog_roundtrip": q("catalog", f"""SELECT clave, nombre, {r6('latitud', 'longitud')}, CASE WHEN altitud <= 2500 THEN altitud END AS altitud,
        estado, region_hidrologica FROM catalog"""),
    "series_urls": q("catalog", "SELECT clave, 'https://sih.conagua.gob.mx/basedatos/Hidros/' || clave || '.csv' AS url FROM catalog"),
    "region_sample": q("catalog", "SELECT DISTINCT region_hidrologica FROM catalog ORDER BY 1 LIMIT 8"),
    "catalog_keys": q("catalog", "SELECT clave FROM catalog WHERE clave IS NOT NULL"),
    "add_lags": q("daily daily_full", f"""SELECT {KEY}, {r6('v')}, ROUND(LAG(v, 1) OVER w, 6) + 0.0 AS v_lag1, ROUND(LAG(v, 3) OVER w, 6) + 0.0 AS v_lag3,
        ROUND(LAG(v, 7) OVER w, 6) + 0.0 AS v_lag7 FROM daily_full WINDOW w AS (PARTITION BY clave_estacion ORDER BY fecha)"""),
    "add_rolling": q("daily daily_full", f"""SELECT {KEY}, {r6('v')}, CASE WHEN COUNT(v) OVER a >= 3 THEN ROUND(AVG(v) OVER a, 6) + 0.0 END AS v_ma7,
        CASE WHEN COUNT(v) OVER b >= 15 THEN ROUND(AVG(v) OVER b, 6) + 0.0 END AS v_ma30 FROM daily_full
        WINDOW a AS (PARTITION BY clave_estacion ORDER BY fecha ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
               b AS (PARTITION BY clave_estacion ORDER BY fecha ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""),
    "zscore": q("daily", f"SELECT {KEY}, {_z('v')} FROM daily"),
    "zscore_stats": q("daily", "SELECT clave_estacion, ROUND(AVG(v), 6) AS v_mean, ROUND(STDDEV_SAMP(v), 6) AS v_std FROM daily GROUP BY 1"),
    "make_windows": q("daily daily_full", """, n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY clave_estacion ORDER BY fecha) AS rn FROM daily_full)
        SELECT s.clave_estacion, CAST(s.fecha AS VARCHAR) AS inicio, ROUND(y.v, 6) + 0.0 AS y, CAST(x.rn - s.rn AS INTEGER) AS paso, ROUND(x.v, 6) + 0.0 AS v
        FROM n s JOIN n x ON x.clave_estacion = s.clave_estacion AND x.rn BETWEEN s.rn AND s.rn + 6
        JOIN n y ON y.clave_estacion = s.clave_estacion AND y.rn = s.rn + 7"""),
    "feature_table": q(FEAT, f"SELECT * FROM (SELECT {KEY}, fuente, calidad, gasto_medio_m3s IS NOT NULL AS keep, "
                       + _z("gasto_medio_m3s") + ", " + ", ".join(_z(c) for c in FEATURES if c != "gasto_medio_m3s")
                       + " FROM features_raw)"),
    "feature_windows": q(FEAT, """, n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY clave_estacion ORDER BY fecha) AS rn
        FROM features_raw WHERE gasto_medio_m3s IS NOT NULL)
        SELECT s.clave_estacion, CAST(s.fecha AS VARCHAR) AS inicio, CAST(x.rn - s.rn AS INTEGER) AS paso,
          ROUND(CAST(CAST(y.gasto_medio_m3s AS FLOAT) AS DOUBLE), 6) AS y, ROUND(CAST(CAST(x.gasto_medio_m3s AS FLOAT) AS DOUBLE), 6) AS gasto_medio_m3s,
          ROUND(CAST(CAST(COALESCE(x.gasto_medio_m3s_lag1, 0) AS FLOAT) AS DOUBLE), 6) AS gasto_medio_m3s_lag1,
          ROUND(CAST(CAST(COALESCE(x.precip_idw_mm, 0) AS FLOAT) AS DOUBLE), 6) AS precip_idw_mm
        FROM n s JOIN n x ON x.clave_estacion = s.clave_estacion AND x.rn BETWEEN s.rn AND s.rn + 4
        JOIN n y ON y.clave_estacion = s.clave_estacion AND y.rn = s.rn + 6"""),
    "spi_z": q("monthly", _spi("precip_mm", "spi3")),
    "spi_gamma": q("monthly", _GAMMA),
    "spei_z": q("monthly", _spi("(precip_mm - pet_mm)", "spei3")),
    "select_candidates": q("catalog", f"""SELECT clave, nombre, {r6('latitud', 'longitud')}, altitud, estado, region_hidrologica
        FROM catalog WHERE region_hidrologica IN ('12', '18', '26')"""),
    "series_of_candidates": q("hydro catalog", f"""SELECT {KEY}, {r6('gasto_medio_m3s')}, fuente, calidad FROM hydro
        WHERE clave_estacion IN (SELECT clave FROM catalog WHERE region_hidrologica IN ('12', '18', '26'))"""),
    "coverage_of_candidates": q("hydro catalog coverage hydro_scored", f"SELECT clave, {r6('cobertura')} FROM hydro_scored"),
    "select_refined": q(SEL, f"SELECT clave, {r6('cobertura')}, vecinos_clima FROM hydro_scored LEFT JOIN selected_lists USING (clave) WHERE cobertura >= 0.40"),
    "select_climate": q("climate climate_catalog climate_selected", f"SELECT clave, {r6('cobertura')} FROM climate_selected"),
    "select_extended": q(SEL, f"""SELECT clave, {r6('cobertura')}, vecinos_clima, 'sensibilidad_reconstruccion' AS uso_recomendado
        FROM hydro_scored LEFT JOIN selected_lists USING (clave) WHERE cobertura >= 0.30 AND cobertura < 0.40"""),
    "knn_stations": q(KNN, f"SELECT clave, CAST(orden AS INTEGER) AS orden, vecino, {r6('dist_km')} FROM nearest WHERE orden <= 3"),
    "knn_lists": q(KNN, "SELECT clave, STRING_AGG(vecino, ',' ORDER BY orden) AS vecinos_clima FROM nearest WHERE orden <= 5 GROUP BY 1"),
    "idw": q(f"climate {KNN} idw", f"SELECT {KEY}, {r6('idw')} FROM idw"),
    "attach_catalog": q("hydro catalog hydro_cat", f"""SELECT {KEY}, {r6('gasto_medio_m3s', 'latitud', 'longitud')}, fuente, calidad,
        region_hidrologica, estado FROM hydro_cat"""),
    "station_inventory": q("hydro catalog hydro_cat", """SELECT region_hidrologica, COUNT(DISTINCT clave_estacion) AS n_estaciones FROM hydro_cat
        WHERE region_hidrologica IS NOT NULL GROUP BY 1"""),
    "station_total": q("hydro", "SELECT COUNT(DISTINCT clave_estacion) AS n_estaciones FROM hydro"),
    "coverage_fixed": q("hydro coverage", f"""SELECT clave_estacion, n_obs, dias_periodo, {r6('cobertura')}, CAST(inicio AS VARCHAR) AS inicio,
        CAST(fin AS VARCHAR) AS fin FROM coverage"""),
    "coverage_span": q("climate climate_full", """SELECT clave_estacion, COUNT(precip_mm) AS n_obs, CAST(MAX(fecha) - MIN(fecha) + 1 AS INTEGER) AS dias_periodo,
        ROUND(COUNT(precip_mm) / CAST(MAX(fecha) - MIN(fecha) + 1 AS DOUBLE), 6) AS cobertura, CAST(MIN(fecha) AS VARCHAR) AS inicio,
        CAST(MAX(fecha) AS VARCHAR) AS fin FROM climate_full GROUP BY 1"""),
    "coverage_hist": q("hydro coverage", """, b AS (SELECT MIN(cobertura) * 100 AS a, MAX(cobertura) * 100 AS b FROM coverage)
        SELECT bin, ROUND(a + (bin - 1) * (b - a) / 20, 6) AS desde, ROUND(a + bin * (b - a) / 20, 6) AS hasta, n FROM (
          SELECT CAST(LEAST(FLOOR((cobertura * 100 - a) / (b - a) * 20), 19) + 1 AS INTEGER) AS bin, a, b, COUNT(*) AS n FROM coverage, b GROUP BY ALL)"""),
    "coverage_summary": q("hydro coverage", """SELECT COUNT(*) AS n_estaciones_total, ROUND(AVG(cobertura) * 100, 6) AS cobertura_media_pct,
        COUNT(*) FILTER (cobertura >= 0.60) AS estaciones_ge_60pct, COUNT(*) FILTER (cobertura >= 0.80) AS estaciones_ge_80pct FROM coverage"""),
    "quality_summary": q("flow flow_limits", """, f AS (SELECT CASE WHEN gasto_medio_m3s < 0 OR gasto_medio_m3s > 3 * q999 THEN 2 ELSE 0 END AS c
          FROM flow JOIN flow_limits USING (clave_estacion))
        SELECT k AS calidad, label AS etiqueta, COUNT(c) AS n, ROUND(COUNT(c) * 100.0 / (SELECT COUNT(*) FROM f), 6) AS pct
        FROM (VALUES (0, 'ok'), (1, 'imputed'), (2, 'outlier')) t(k, label) LEFT JOIN f ON c = k GROUP BY ALL"""),
    "monthly_climatology": q("flow", """SELECT CAST(MONTH(fecha) AS INTEGER) AS mes, ROUND(AVG(gasto_medio_m3s), 6) AS mean, ROUND(STDDEV_SAMP(gasto_medio_m3s), 6) AS std,
        COUNT(gasto_medio_m3s) AS count FROM flow GROUP BY 1"""),
    "annual_means": q("flow", "SELECT CAST(YEAR(fecha) AS INTEGER) AS anio, ROUND(AVG(gasto_medio_m3s), 6) AS gasto_medio_m3s FROM flow GROUP BY 1"),
    "season_stats": q("flow season_flow", """SELECT temporada, ROUND(AVG(v), 2) AS mean, ROUND(QUANTILE_CONT(v, 0.5), 2) AS median, ROUND(MAX(v), 2) AS max
        FROM season_flow GROUP BY 1"""),
    "describe": q("flow", "SELECT COUNT(v) AS count, ROUND(AVG(v), 6) AS mean, ROUND(STDDEV_SAMP(v), 6) AS std, ROUND(MIN(v), 6) AS min, ROUND(MAX(v), 6) AS max, "
                  + ", ".join(f"ROUND(QUANTILE_CONT(v, {p / 100}), 6) AS p{p:02d}" for p in (5, 25, 50, 75, 95))
                  + " FROM (SELECT gasto_medio_m3s AS v FROM flow)"),
    "boxplot_region": q("hydro catalog hydro_cat", """, k AS (SELECT region_hidrologica, QUANTILE_CONT(gasto_medio_m3s, 0.25) AS q1, QUANTILE_CONT(gasto_medio_m3s, 0.5) AS median,
          QUANTILE_CONT(gasto_medio_m3s, 0.75) AS q3 FROM hydro_cat GROUP BY 1)
        SELECT region_hidrologica, ROUND(q1, 6) AS q1, ROUND(median, 6) AS median, ROUND(q3, 6) AS q3,
          ROUND(MIN(gasto_medio_m3s) FILTER (gasto_medio_m3s >= q1 - (q3 - q1) * 1.5), 6) AS whisker_low,
          ROUND(MAX(gasto_medio_m3s) FILTER (gasto_medio_m3s <= q3 + (q3 - q1) * 1.5), 6) AS whisker_high, COUNT(*) AS n
        FROM hydro_cat JOIN k USING (region_hidrologica) GROUP BY region_hidrologica, q1, median, q3"""),
    "exact_quantiles": " UNION ALL ".join(
        f"""SELECT l_returnflag, l_linestatus, CAST({p} AS DOUBLE) AS prob, ROUND(QUANTILE_CONT(l_extendedprice, {p}), 6) AS quantile
        FROM lineitem GROUP BY 1, 2""" for p in (0.001, 0.5, 0.999)),
    "lagged_corr": q("hydro hydro_full climate", f""", j AS (SELECT h.clave_estacion, h.gasto_medio_m3s AS g, c.precip_mm AS p,
          ROW_NUMBER() OVER (PARTITION BY h.clave_estacion ORDER BY h.fecha) AS rn FROM hydro_full h
          LEFT JOIN climate c ON c.clave_estacion = 'C' || h.clave_estacion AND c.fecha = h.fecha) {_PAIRED}"""),
    "national_lag_corr": q("climate hydro national national_corr", f"SELECT lag, {r6('corr')}, n_fechas FROM national_corr"),
    "best_lag": q("climate hydro national national_corr", """SELECT ARG_MAX(lag, corr) AS lag_max_correlacion_dias, ROUND(MAX(corr), 6) AS correlacion_max,
        MAX(n_fechas) AS n_fechas_comunes FROM national_corr"""),
    "cross_source": q("hydro source_b", f"""SELECT clave_estacion, COUNT(*) AS n, ROUND({_corr('a.gasto_medio_m3s', 'b.gasto_medio_m3s')}, 6) + 0.0 AS corr,
        ROUND(AVG(a.gasto_medio_m3s - b.gasto_medio_m3s), 6) + 0.0 AS sesgo FROM hydro a JOIN source_b b USING (clave_estacion, fecha)
        GROUP BY 1 HAVING COUNT(*) >= 5"""),
    "cross_source_default": q("hydro source_b", f"""SELECT clave_estacion, COUNT(*) AS n, ROUND({_corr('a.gasto_medio_m3s', 'b.gasto_medio_m3s')}, 6) + 0.0 AS corr,
        ROUND(AVG(a.gasto_medio_m3s - b.gasto_medio_m3s), 6) + 0.0 AS sesgo FROM hydro a JOIN source_b b USING (clave_estacion, fecha)
        GROUP BY 1 HAVING COUNT(*) >= 10"""),
    "common_stations": q("hydro source_b", "SELECT clave_estacion FROM hydro INTERSECT SELECT clave_estacion FROM source_b"),
    "dataset_summary": q("hydro", """SELECT COUNT(DISTINCT clave_estacion) AS n_estaciones, COUNT(*) AS n_filas, CAST(MIN(fecha) AS VARCHAR) AS fecha_min,
        CAST(MAX(fecha) AS VARCHAR) AS fecha_max FROM hydro"""),
    "located_stations": q("hydro catalog hydro_cat", """SELECT clave_estacion, CAST(MIN(fecha) AS VARCHAR) AS fecha, ROUND(MIN(latitud), 6) AS latitud,
        ROUND(MIN(longitud), 6) AS longitud FROM hydro_cat WHERE latitud IS NOT NULL AND longitud IS NOT NULL GROUP BY 1"""),
    "sub_basin_counts": """SELECT CAST(s_nationkey AS VARCHAR) AS region_hidrologica, COUNT(*) AS n_subcuencas FROM supplier GROUP BY ROLLUP (1)""",
    "report_metrics": q("hydro climate catalog hydro_cat coverage national national_corr", _metrics()),
    "bbox": q("catalog", _bbox(0.15)),
    "bbox_by_region": q("catalog", _bbox(0.1, "region_hidrologica")),
    "bbox_filter": q("catalog", f"""SELECT clave, cuenca FROM catalog JOIN (VALUES {_PILOT}) t(cuenca, a, b, c, d)
        ON longitud BETWEEN a AND c AND latitud BETWEEN b AND d"""),
    "assign_basin": q("catalog boxes0", """SELECT c.clave, CAST(p.s_nationkey AS VARCHAR) AS region_hidrologica, p.s_name AS cuenca FROM catalog c LEFT JOIN boxes0 p
        ON longitud > x0 AND longitud < x0 + 2 AND latitud > y0 AND latitud < y0 + 2
        AND (s_suppkey % 2 = 0 OR longitud < x0 + 1 OR latitud < y0 + 1)"""),
    "reproject_lcc": q("catalog", f"SELECT clave, ROUND({X}, 3) AS x_m, ROUND({Y}, 3) AS y_m FROM catalog"),
    "polygon_area": q("boxes0", f""", v AS (SELECT s_name, k, x0 + dx AS x, y0 + dy AS y FROM boxes0 JOIN (VALUES
          (0, 1, 0, 0), (0, 2, 2, 0), (0, 3, 2, 2), (0, 4, 0, 2),
          (1, 1, 0, 0), (1, 2, 2, 0), (1, 3, 2, 1), (1, 4, 1, 1), (1, 5, 1, 2), (1, 6, 0, 2)) t(kind, k, dx, dy) ON kind = s_suppkey % 2),
        m AS (SELECT s_name, k, {VX} AS e, {VY} AS n FROM v),
        w AS (SELECT s_name, e, n, LEAD(e) OVER o AS e2, LEAD(n) OVER o AS n2, FIRST_VALUE(e) OVER o AS e0, FIRST_VALUE(n) OVER o AS n0
              FROM m WINDOW o AS (PARTITION BY s_name ORDER BY k))
        SELECT s_name AS cuenca, ROUND(ABS(SUM((e - e0) * (COALESCE(n2, n0) - n0) - (COALESCE(e2, e0) - e0) * (n - n0))) / 2 / 1e6, 4) AS area_km2
        FROM w GROUP BY 1"""),
    "assign_basin_multi": q("catalog boxes0", """SELECT c.clave, CAST(p.s_nationkey AS VARCHAR) AS region_hidrologica, p.s_name AS cuenca FROM catalog c LEFT JOIN boxes0 p
        ON (longitud > x0 AND longitud < x0 + 2 AND latitud > y0 AND latitud < y0 + 2
            AND (NOT (longitud > x0 + 0.5 AND longitud < x0 + 1.5 AND latitud > y0 + 0.5 AND latitud < y0 + 1.5)
                 OR (longitud > x0 + 0.8 AND longitud < x0 + 1.2 AND latitud > y0 + 0.8 AND latitud < y0 + 1.2)))
        OR (longitud > x0 + 2.5 AND longitud < x0 + 3.2 AND latitud > y0 AND latitud < y0 + 0.6 AND (latitud - y0) * 0.7 < (longitud - x0 - 2.5) * 0.6)"""),
    "polygon_area_multi": q("boxes0", f"""{_area_of_rings()} SELECT s_name AS cuenca, ROUND(SUM(CASE WHEN r = 1 THEN -a ELSE a END), 4) AS area_km2 FROM a GROUP BY 1"""),
    "zonal_by_polygon": q("px", _zonal()),
    "inverse_lcc": q("catalog", f"SELECT clave, {r6('latitud', 'longitud')} FROM catalog"),
    "tiles_projected": q("catalog estado_boxes", _tiles_projected()),
    "mosaic_aligned": q("tiles", _mosaic_aligned()),
    "clip_projected": q("px grids", _clip_projected()),
    "tiles_for_boxes": q("catalog boxes0 estado_boxes", """SELECT s_name AS tile, estado AS cuenca FROM boxes0 JOIN estado_boxes
        ON NOT (x0 + 2 < a1 OR x0 > a2 OR y0 + 2 < b1 OR y0 > b2)"""),
    "basin_slug": "SELECT s_name AS cuenca, REPLACE(REPLACE(LOWER(s_name), ' ', '_'), '-', '_') AS archivo FROM supplier",
    "pour_points": q("catalog", """SELECT clave, CAST(FLOOR((33.0::DOUBLE - latitud) / 0.03::DOUBLE) AS INTEGER) AS "row",
        CAST(FLOOR((longitud - -118.5::DOUBLE) / 0.03::DOUBLE) AS INTEGER) AS col FROM catalog"""),
    "raster_mosaic": q("tiles", """SELECT basin, "row", col, ROUND(ARG_MIN(z, path), 6) AS z FROM tiles GROUP BY ALL"""),
    "raster_clip": q("px", """SELECT basin, "row", col, ROUND(z, 6) AS z FROM px WHERE -100.5 + (col + 0.5) * 0.03 BETWEEN -100.3 AND -99.6
        AND 20.0 - ("row" + 0.5) * 0.03 BETWEEN 19.6 AND 19.95"""),
    "raster_coarser": q("px grids", _resample(2.0)),
    "raster_finer": q("px grids", _resample(0.5)),
    "d8_pointer": q("px steps pointer", 'SELECT basin, "row", col, ROUND(z, 6) AS z, to_row, to_col FROM pointer'),
    "flow_accumulation": q("px steps pointer walk acc", 'SELECT basin, "row", col, acc FROM acc'),
    "d8_flats": q(FLATS, 'SELECT basin, "row", col, z, to_row, to_col FROM pointer_flat'),
    "flow_accumulation_flats": q(f"{FLATS} walk_f acc_f", 'SELECT basin, "row", col, acc FROM acc_f'),
    "watershed_flats": q(f"{FLATS} outlets trail_f sheds_f", 'SELECT basin, "row", col, clave FROM sheds_f'),
    "extract_streams": q("px steps pointer walk acc", 'SELECT basin, "row", col, acc FROM acc WHERE acc >= 5'),
    "snap_points": q("px steps pointer walk acc outlets", """SELECT clave, basin, "row", col FROM (
        SELECT o.clave, o.basin, a."row", a.col, ROW_NUMBER() OVER (PARTITION BY o.clave
          ORDER BY POW(a."row" - o."row", 2) + POW(a.col - o.col, 2), a."row", a.col) AS k
        FROM outlets o JOIN acc a ON a.basin = o.basin AND a.acc >= 5
          AND POW(a."row" - o."row", 2) + POW(a.col - o.col, 2) <= 9) WHERE k = 1"""),
    "watershed_clipped": q("px steps pointer pointer_c outlets outlets_c trail_c sheds_c", 'SELECT basin, "row", col, clave FROM sheds_c'),
    "watershed": q("px steps pointer outlets trail sheds", 'SELECT basin, "row", col, clave FROM sheds'),
    "basin_attributes": q("px steps pointer outlets trail sheds", f""", sz AS (SELECT s.*, p.z FROM sheds s JOIN px p USING (basin, "row", col) WHERE clave IS NOT NULL),
        e AS (SELECT clave, basin, MIN("row") AS r0, MAX("row") AS r1, MIN(col) AS c0, MAX(col) AS c1 FROM sz GROUP BY ALL)
        SELECT clave, COUNT(*) AS celdas, ROUND(COUNT(*) * 0.0009::DOUBLE, 6) AS area_km2, ROUND(AVG(z), 6) AS elevacion_media,
          ROUND(AVG(g), 6) AS pendiente_media FROM (
          SELECT s.clave, s.z, DEGREES(ATAN(SQRT(POW({_GRAD_Y}, 2) + POW({_GRAD_X}, 2)))) AS g FROM sz s JOIN e USING (clave, basin)
          {_nb('u', -1, 0)} {_nb('d', 1, 0)} {_nb('l', 0, -1)} {_nb('r', 0, 1)}) GROUP BY 1"""),
}
ORACLE["windows_store"] = ORACLE["feature_windows"]
_KEPT = ", ".join(("clave_estacion", "fecha", "fuente", "calidad", *FEATURES))
ORACLE["feature_table"] = ORACLE["feature_table"].replace("SELECT * FROM (SELECT", f"SELECT {_KEPT} FROM (SELECT", 1) + " WHERE keep"
ORACLE["coverage_observed"] = ORACLE["coverage_span"]
