"""The SQL of the flight queries, for DuckDB."""

from __future__ import annotations

from fluxspan.operators.linalg import ALPHAS
from fluxspan.plans.flight_queries import _LASSO, DIPOLE, FLIGHT
from fluxspan.schema import COSINES, EDDY, INDUCED, RATES, TERMS

WF = "(PARTITION BY flight_id ORDER BY row_idx)"
_BASE = f"""f AS ({FLIGHT}),
c AS (SELECT *, B_x / sqrt(B_x * B_x + B_y * B_y + B_z * B_z) AS cos_x, B_y / sqrt(B_x * B_x + B_y * B_y + B_z * B_z) AS cos_y, B_z / sqrt(B_x * B_x + B_y * B_y + B_z * B_z) AS cos_z FROM f)"""


def _central(x: str, w: str) -> str:
    hs, hd = f"(time - lag(time) OVER {w})", f"(lead(time) OVER {w} - time)"
    up, down = f"(lead({x}) OVER {w} - {x})", f"({x} - lag({x}) OVER {w})"
    return f"CASE WHEN lag(time) OVER {w} IS NULL THEN {up} / {hd} WHEN lead(time) OVER {w} IS NULL THEN {down} / {hs} ELSE ({hs} * {up} / {hd} + {hd} * {down} / {hs}) / ({hs} + {hd}) END"


def _causal(x: str, w: str) -> str:
    return f"CASE WHEN lag(time) OVER {w} IS NULL THEN (lead({x}) OVER {w} - {x}) / (lead(time) OVER {w} - time) ELSE ({x} - lag({x}) OVER {w}) / (time - lag(time) OVER {w}) END"


def _rates(kind: str, w: str = WF, source: str = "c") -> str:
    if kind == "imu":
        exprs = dict(zip(RATES, ("roll_rate", "pitch_rate", "yaw_rate")))
    else:
        exprs = {r: (_central if kind == "central" else _causal)(x, w) for r, x in zip(RATES, COSINES)}
    return f"r AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in exprs.items())} FROM {source})"


def _product(term: str) -> str:
    if term in INDUCED:
        return term[:5] + " * " + term[6:]
    if term in EDDY:
        return term[:5] + " * " + term[6:]
    return term


def _long(ctes: str, source: str, terms, digits: int = 6) -> str:
    return f"WITH {ctes} " + " UNION ALL ".join(f"SELECT flight_id, row_idx, '{t}' AS term, round({_product(t)}, {digits}) + 0.0 AS value FROM {source}" for t in terms)


_SEG = f"""m AS (SELECT *, CASE WHEN segment IS NOT DISTINCT FROM lag(segment) OVER {WF} AND lag(row_idx) OVER {WF} IS NOT NULL THEN 0 ELSE 1 END AS fresh FROM c),
s AS (SELECT *, CAST(sum(fresh) OVER {WF} AS INT) AS seg_ord, split_part(segment, '_', 1) AS seg_maneuver, split_part(segment, '_', 2) AS seg_heading FROM m)"""
_DELTA = f"""{_BASE}, {_SEG},
d AS (SELECT *, B_total - avg(CASE WHEN seg_maneuver = 'steady' THEN B_total END) OVER (PARTITION BY flight_id) AS delta_B FROM s)"""
_REF = """folded AS (SELECT flight_id, ((degrees(atan2(avg(sin(radians(((heading % 90) + 90) % 90))), avg(cos(radians(((heading % 90) + 90) % 90))))) % 90) + 90) % 90 AS ref FROM f GROUP BY flight_id),
spokes AS (SELECT flight_id, ref, k, (ref + 90.0 * k) % 360 AS spoke FROM folded, (SELECT unnest([0, 1, 2, 3]) AS k)),
north AS (SELECT flight_id, ref, arg_min(k, least(spoke, 360 - spoke) * 10 + k * 1e-9) AS k0 FROM spokes GROUP BY flight_id, ref),
centres AS (SELECT flight_id, ref, (ref + 90.0 * (k0 % 4)) % 360 AS n, (ref + 90.0 * ((k0 + 1) % 4)) % 360 AS e, (ref + 90.0 * ((k0 + 2) % 4)) % 360 AS s, (ref + 90.0 * ((k0 + 3) % 4)) % 360 AS w FROM north)"""


def _away(h: str, c: str) -> str:
    return f"abs((({h} - {c} + 180) % 360 + 360) % 360 - 180)"


_BINNED = f"""{_BASE}, {_REF},
away AS (SELECT c.*, {_away('heading', 'n')} AS dn, {_away('heading', 'e')} AS de, {_away('heading', 's')} AS ds, {_away('heading', 'w')} AS dw FROM c JOIN centres USING (flight_id)),
b AS (SELECT *, CASE WHEN least(dn, de, ds, dw) > 45 THEN NULL WHEN dn <= least(de, ds, dw) THEN 'N' WHEN de <= least(ds, dw) THEN 'E' WHEN ds <= dw THEN 'S' ELSE 'W' END AS bin FROM away)"""
_STEP = "(radians(heading) - lag(radians(heading)) OVER w)"
_FIX = f"(CASE WHEN abs({_STEP}) < pi() THEN 0.0 ELSE -2 * pi() * round({_STEP} / (2 * pi())) END)"
_TURNED = f"turned AS (SELECT *, radians(heading) + coalesce(sum(coalesce(fix, 0.0)) OVER {WF}, 0.0) AS heading_unwrapped FROM (SELECT *, {_FIX} AS fix FROM b WINDOW w AS {WF}))"
_RATED = f"""{_BINNED}, {_TURNED},
rated AS (SELECT *, {_central('pitch', WF)} AS pitch_deg_s, {_central('roll', WF)} AS roll_deg_s,
  CASE WHEN lag(row_idx) OVER {WF} IS NOT NULL AND bin IS DISTINCT FROM lag(bin) OVER {WF} THEN 0.0 ELSE degrees({_central('heading_unwrapped', WF)}) END AS yaw_deg_s FROM turned),
lab AS (SELECT *, CASE WHEN greatest(abs(pitch_deg_s), abs(roll_deg_s), abs(yaw_deg_s)) < 1.0 THEN 'steady' WHEN abs(pitch_deg_s) >= abs(roll_deg_s) AND abs(pitch_deg_s) >= abs(yaw_deg_s) THEN 'pitch'
  WHEN abs(roll_deg_s) >= abs(pitch_deg_s) AND abs(roll_deg_s) >= abs(yaw_deg_s) THEN 'roll' ELSE 'yaw' END AS maneuver FROM rated)"""


def _gram(terms, keys: str = "", source: str = "r") -> str:
    cols = [_product(t) for t in terms] + ["delta_B"]
    select = f"{keys}, " if keys else ""
    named = {"seg_heading": "seg_heading AS heading", "seg_maneuver": "seg_maneuver AS maneuver"}
    shown = f"{named[keys]}, " if keys else ""
    sums = ", ".join(f"sum(({a}) * ({b})) AS g_{i}_{j}" for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i)
    rows = " UNION ALL ".join(f"SELECT {shown}{i} AS i, {j} AS j, round(g_{i}_{j}, 4) + 0.0 AS value FROM g" for i in range(len(cols)) for j in range(i, len(cols)))
    group = f" GROUP BY {keys}" if keys else ""
    return f"g AS (SELECT {select}{sums} FROM {source}{group}) {rows}"


_G3 = "count(*) AS n, sum(cos_x * cos_x) AS a, sum(cos_x * cos_y) AS b, sum(cos_x * cos_z) AS c, sum(cos_y * cos_y) AS d, sum(cos_y * cos_z) AS e, sum(cos_z * cos_z) AS f, sum(cos_x * delta_B) AS p, sum(cos_y * delta_B) AS q, sum(cos_z * delta_B) AS r, sum(delta_B * delta_B) AS yy, sum(delta_B) AS y1, sum(cos_x) AS s0, sum(cos_y) AS s1, sum(cos_z) AS s2"


def _cramer(alpha: str = "0.0", pre: str = "") -> list[str]:
    a, b, c, d, e, f, p, q, r = (f"{pre}{x}" for x in "abcdefpqr")
    a, d, f = f"({a} + {alpha})", f"({d} + {alpha})", f"({f} + {alpha})"
    det = f"({a} * ({d} * {f} - {e} * {e}) - {b} * ({b} * {f} - {e} * {c}) + {c} * ({b} * {e} - {d} * {c}))"
    x = f"({p} * ({d} * {f} - {e} * {e}) - {b} * ({q} * {f} - {e} * {r}) + {c} * ({q} * {e} - {d} * {r}))"
    y = f"({a} * ({q} * {f} - {e} * {r}) - {p} * ({b} * {f} - {e} * {c}) + {c} * ({b} * {r} - {q} * {c}))"
    z = f"({a} * ({d} * {r} - {q} * {e}) - {b} * ({b} * {r} - {q} * {c}) + {p} * ({b} * {e} - {d} * {c}))"
    return [f"{v} / {det}" for v in (x, y, z)]


def _fit(key: str = "", alpha: str = "0.0") -> str:
    """CTEs up to ``w``: coefficients w0, w1, w2 per group."""
    select, group = (f"{key}, ", f" GROUP BY {key}") if key else ("", "")
    w = ", ".join(f"{x} AS w{i}" for i, x in enumerate(_cramer(alpha)))
    return f"{_DELTA}, g AS (SELECT {select}{_G3} FROM d{group}), w AS (SELECT *, {w} FROM g)"


def _coefficients(ctes: str, key: str = "", name: str = "", source: str = "w") -> str:
    shown = f"{key} AS {name}, " if key else ""
    return f"WITH {ctes} " + " UNION ALL ".join(f"SELECT {shown}n, {i} AS i, round(w{i}, 6) + 0.0 AS value FROM {source}" for i in range(3))


_MODEL = "(w0 * cos_x + w1 * cos_y + w2 * cos_z)"


def _descent(l1: str, l2: str) -> str:
    """Coordinate descent on the pooled 3 x 3 Gram matrix, one sweep a step."""
    soft = lambda rho, diag: f"sign({rho}) * greatest(abs({rho}) - {l1}, 0.0) / ({diag} + {l2})"
    w0 = soft("(p - b * v1 - c * v2)", "a")
    w1 = soft("(q - b * x0 - e * v2)", "d")
    w2 = soft("(r - c * x0 - e * x1)", "f")
    return f"""WITH RECURSIVE {_DELTA}, g AS (SELECT {_G3} FROM d),
steps(k, v0, v1, v2) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
  SELECT k + 1, x0, x1, {w2} FROM (SELECT *, {w1} AS x1 FROM (SELECT *, {w0} AS x0 FROM steps, g WHERE k < 300))),
w AS (SELECT n, v0 AS w0, v1 AS w1, v2 AS w2 FROM steps, g WHERE k = 300)
""" + " UNION ALL ".join(f"SELECT n, {i} AS i, round(w{i}, 6) + 0.0 AS value FROM w" for i in range(3))


def _blocks() -> str:
    """CTEs up to ``train`` and ``test``: sums of each fold's rows."""
    return f"""{_DELTA}, pos AS (SELECT *, row_number() OVER (ORDER BY flight_id, seg_ord, row_idx) - 1 AS spot, count(*) OVER () AS total FROM d),
blk AS (SELECT *, CASE WHEN spot < total - 5 * (total // 6) THEN 0 ELSE (spot - (total - 5 * (total // 6))) // (total // 6) + 1 END AS block FROM pos),
test AS (SELECT block, {_G3} FROM blk GROUP BY block),
train AS (SELECT t.block, {', '.join(f'sum(u.{x}) AS t{x}' for x in 'nabcdefpqr')} FROM test t JOIN test u ON u.block < t.block WHERE t.block > 0 GROUP BY t.block)"""


def _ridge_cv() -> str:
    blocks = f"""{_blocks()},
grid AS (SELECT unnest({[float(x) for x in ALPHAS]}) AS alpha),
fits AS (SELECT block, alpha, {', '.join(f'{x} AS w{i}' for i, x in enumerate(_cramer('alpha', 't')))} FROM train, grid),
scored AS (SELECT alpha, avg(1 - (yy - 2 * (w0 * p + w1 * q + w2 * r) + w0 * w0 * a + w1 * w1 * d + w2 * w2 * f + 2 * (w0 * w1 * b + w0 * w2 * c + w1 * w2 * e)) / (yy - y1 * y1 / n)) AS r2
  FROM fits JOIN test USING (block) GROUP BY alpha),
best AS (SELECT arg_max(alpha, r2) AS alpha FROM scored), g AS (SELECT {_G3} FROM d),
w AS (SELECT n, alpha, {', '.join(f'{x} AS w{i}' for i, x in enumerate(_cramer('alpha')))} FROM g, best)"""
    return f"WITH {blocks} " + " UNION ALL ".join(f"SELECT n, round(alpha, 5) + 0.0 AS selected_alpha, {i} AS i, round(w{i}, 5) + 0.0 AS value FROM w" for i in range(3))


def _elastic_cv(ratio: float) -> str:
    """Coordinate descent for every fold and strength at once, then for all rows
    with the strength whose folds err least."""
    soft = lambda rho, l1, diag, l2: f"sign({rho}) * greatest(abs({rho}) - {l1}, 0.0) / ({diag} + {l2})"
    sweep = lambda t, l1, l2: (soft(f"({t}p - {t}b * v1 - {t}c * v2)", l1, f"{t}a", l2), soft(f"({t}q - {t}b * x0 - {t}e * v2)", l1, f"{t}d", l2), soft(f"({t}r - {t}c * x0 - {t}e * x1)", l1, f"{t}f", l2))
    a0, a1, a2 = sweep("t", f"(tn * alpha * {ratio})", f"(tn * alpha * {1 - ratio})")
    b0, b1, b2 = sweep("", f"(n * alpha * {ratio})", f"(n * alpha * {1 - ratio})")
    return f"""WITH RECURSIVE {_blocks()},
whole AS MATERIALIZED (SELECT {_G3} FROM d),
grid AS (SELECT greatest(abs(p), abs(q), abs(r)) / (n * {ratio}) * pow(10.0, -3.0 * k / 99) AS alpha FROM whole, (SELECT unnest(range(100)) AS k)),
cases AS MATERIALIZED (SELECT * FROM train, grid),
steps(i, block, alpha, v0, v1, v2) AS (SELECT 0, block, alpha, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM cases UNION ALL
  SELECT i + 1, block, alpha, x0, x1, {a2} FROM (SELECT *, {a1} AS x1 FROM (SELECT *, {a0} AS x0 FROM steps JOIN cases USING (block, alpha) WHERE i < 200))),
scored AS (SELECT alpha, avg((yy - 2 * (v0 * p + v1 * q + v2 * r) + v0 * v0 * a + v1 * v1 * d + v2 * v2 * f + 2 * (v0 * v1 * b + v0 * v2 * c + v1 * v2 * e)) / n) AS mse FROM steps JOIN test USING (block) WHERE i = 200 GROUP BY alpha),
best AS MATERIALIZED (SELECT whole.*, arg_min(alpha, mse) AS alpha FROM scored, whole GROUP BY ALL),
ends(i, v0, v1, v2) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
  SELECT i + 1, x0, x1, {b2} FROM (SELECT *, {b1} AS x1 FROM (SELECT *, {b0} AS x0 FROM ends, best WHERE i < 300))),
w AS (SELECT n, v0 AS w0, v1 AS w1, v2 AS w2 FROM ends, best WHERE i = 300)
""" + " UNION ALL ".join(f"SELECT n, {i} AS i, round(w{i}, 6) + 0.0 AS value FROM w" for i in range(3))


def _condition() -> str:
    """Eigenvalues of the pooled 3 x 3 Gram matrix in closed form."""
    values = ", ".join(f"sqrt(m + 2 * s * cos(phi + {k} * 2 * pi() / 3)) AS s{i}" for i, k in enumerate((0, 2, 1)))
    shifted = "((a - m) * ((d - m) * (f - m) - e * e) - b * (b * (f - m) - e * c) + c * (b * e - (d - m) * c))"
    return f"""WITH {_DELTA}, g AS (SELECT *, (a + d + f) / 3 AS m FROM (SELECT {_G3} FROM d)),
h AS (SELECT *, sqrt(((a - m) * (a - m) + (d - m) * (d - m) + (f - m) * (f - m) + 2 * (b * b + c * c + e * e)) / 6) AS s FROM g),
k AS (SELECT *, acos(greatest(-1.0, least(1.0, {shifted} / (2 * s * s * s)))) / 3 AS phi FROM h), v AS (SELECT {values} FROM k)
""" + " UNION ALL ".join(f"SELECT round(s0 / s2, 5) + 0.0 AS condition_number, {i} AS i, round(s{i}, 5) + 0.0 AS singular_value FROM v" for i in range(3))


def _dof() -> str:
    ridge = f"3 - {_LASSO!r} * ((D * F - e * e) + (A * F - c * c) + (A * D - b * b)) / (A * (D * F - e * e) - b * (b * F - e * c) + c * (b * e - D * c))"
    shrunk = f"(SELECT a + {_LASSO!r} AS A, b, c, d + {_LASSO!r} AS D, e, f + {_LASSO!r} AS F FROM (SELECT {_G3} FROM d))"
    count = lambda sql: f"(SELECT CAST(count(*) FILTER (WHERE value <> 0) AS DOUBLE) FROM ({sql}))"
    return f"""SELECT 'ridge' AS method, {_LASSO!r}::DOUBLE AS selected_alpha, (WITH {_DELTA} SELECT round({ridge}, 6) + 0.0 FROM {shrunk}) AS effective_dof
UNION ALL SELECT 'lasso', {_LASSO!r}::DOUBLE, {count(_descent(f"{_LASSO / 2!r}", "0.0"))}
UNION ALL SELECT 'elastic_net', {_LASSO!r}::DOUBLE, {count(_descent(f"{_LASSO / 4!r}", f"{_LASSO / 4!r}"))}"""


def _solved(terms) -> str:
    """CTEs up to ``w``: least squares by elimination on the Gram matrix of ``r``."""
    k, cols = len(terms), [_product(t) for t in terms] + ["delta_B"]
    rows = ", ".join("[" + ", ".join(f"sum(({a}) * ({b}))" for b in cols) + "]" for a in cols[:-1])
    scaled = "list_transform(m[i + 1], lambda x: x / m[i + 1][i + 1])"
    cleared = f"list_transform(range(1, {k + 2}), lambda j: m[o][j] - m[o][i + 1] * m[i + 1][j] / m[i + 1][i + 1])"
    return f"""elim(i, m) AS (SELECT 0, [{rows}] FROM r UNION ALL
  SELECT i + 1, list_transform(range(1, {k + 1}), lambda o: CASE WHEN o = i + 1 THEN {scaled} ELSE {cleared} END) FROM elim WHERE i < {k}),
w AS (SELECT list_transform(m, lambda x: x[{k + 1}]) AS w FROM elim WHERE i = {k})"""


def _dipole(g10: float, g11: float, h11: float) -> str:
    """Strength of a dipole field at geodetic positions, in closed form."""
    lean = f"({g11} * cos(radians(lon)) + {h11} * sin(radians(lon)))"
    parts = (f"2 * ({g10} * ct + {lean} * st)", f"({g10} * st - {lean} * ct)", f"({g11} * sin(radians(lon)) - {h11} * cos(radians(lon)))")
    return f"""WITH {_BASE}, track AS (SELECT flight_id, row_idx, alt, lat - flight_id % 100 + 0.01 * row_idx AS lat, lon + 0.02 * row_idx AS lon FROM f),
bent AS (SELECT *, sqrt(pow(6378.137 * cos(radians(lat)), 2) + pow(6356.752314245 * sin(radians(lat)), 2)) AS bend FROM track),
placed AS (SELECT *, (6378.137 * 6378.137 / bend + alt) * cos(radians(lat)) AS x, (6356.752314245 * 6356.752314245 / bend + alt) * sin(radians(lat)) AS z FROM bent),
turned AS (SELECT *, sqrt(x * x + z * z) AS rad, z / sqrt(x * x + z * z) AS ct, x / sqrt(x * x + z * z) AS st FROM placed)
SELECT flight_id, row_idx, round(pow(6371.2 / rad, 3) * sqrt({' + '.join(f'pow({p}, 2)' for p in parts)}), 4) + 0.0 AS baseline FROM turned"""


def _vif() -> str:
    """1 / (1 - R^2) per heading: each cosine on the two others, uncentred, against its centred spread."""
    parts = []
    for i, (own, mean, x, y, gx, gy, xx, xy, yy) in enumerate((("a", "s0", "b", "c", "b", "c", "d", "e", "f"), ("d", "s1", "b", "e", "b", "e", "a", "c", "f"), ("f", "s2", "c", "e", "c", "e", "a", "b", "d"))):
        explained = f"(({x} * ({gx} * {yy} - {gy} * {xy}) + {y} * ({gy} * {xx} - {gx} * {xy})) / ({xx} * {yy} - {xy} * {xy}))"
        total = f"({own} - {mean} * {mean} / n)"
        r2 = f"greatest(0.0, least(1.0, 1 - ({own} - {explained}) / {total}))"
        parts.append(f"SELECT seg_heading AS heading, {i} AS i, round(1 / (1 - {r2}), 5) + 0.0 AS vif FROM g")
    return f"WITH {_fit('seg_heading')} " + " UNION ALL ".join(parts)


def _rls(lam: float) -> str:
    """The recursion row by row, all flights at once; P is kept as its upper triangle."""
    pa = ("(p00 * cx + p01 * cy + p02 * cz)", "(p01 * cx + p11 * cy + p12 * cz)", "(p02 * cx + p12 * cy + p22 * cz)")
    state = ", ".join(f"t{i} + h{i} / s * err AS t{i}" for i in range(3)) + ", " + ", ".join(f"(p{i}{j} - h{i} * h{j} / s) / {lam} AS p{i}{j}" for i in range(3) for j in range(i, 3))
    return f"""WITH RECURSIVE {_DELTA}, x AS MATERIALIZED (SELECT flight_id, row_idx, cos_x AS cx, cos_y AS cy, cos_z AS cz, delta_B AS y FROM d),
st(flight_id, k, t0, t1, t2, p00, p01, p02, p11, p12, p22) AS (SELECT DISTINCT flight_id, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 100.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 100.0::DOUBLE, 0.0::DOUBLE, 100.0::DOUBLE FROM x
  UNION ALL SELECT flight_id, k + 1, {state} FROM (SELECT *, {lam} + cx * h0 + cy * h1 + cz * h2 AS s, y - cx * t0 - cy * t1 - cz * t2 AS err
    FROM (SELECT st.*, cx, cy, cz, y, {', '.join(f'{e} AS h{i}' for i, e in enumerate(pa))} FROM st JOIN x ON x.flight_id = st.flight_id AND x.row_idx = st.k))),
fin AS (SELECT * FROM st QUALIFY k = max(k) OVER (PARTITION BY flight_id))
""" + " UNION ALL ".join(f"SELECT flight_id, CAST(k AS BIGINT) AS n_samples, {i} AS i, round(t{i}, 5) + 0.0 AS value FROM fin" for i in range(3))


_ROLL = "(PARTITION BY flight_id ORDER BY row_idx ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"
_VARS = f"v AS (SELECT *, var_pop(cos_x) OVER {_ROLL} AS vx, var_pop(cos_y) OVER {_ROLL} AS vy, var_pop(cos_z) OVER {_ROLL} AS vz FROM "
_FOM = f"{_fit()}, res AS (SELECT d.*, {_MODEL} - delta_B AS residual FROM d, w)"
_RMS = "round(sqrt(avg(delta_B * delta_B)), 6) + 0.0 AS rms_before, round(sqrt(avg(residual * residual)), 6) + 0.0 AS rms_after, count(*) AS n_samples"

SQL = {
    "validate_counts": f"WITH {_BASE} SELECT count(*) AS n_rows, "
    + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS null_{c}" for c in ("time", "lat", "lon", "alt", "B_total", "B_x", "B_y", "B_z", "roll_rate", "pitch_rate", "yaw_rate"))
    + f", count(*) FILTER (WHERE B_total <= 0) AS not_positive, count(*) FILTER (WHERE step <= 0) AS not_increasing, count(*) FILTER (WHERE B_x * B_x + B_y * B_y + B_z * B_z <= 0) AS zero_vector FROM (SELECT *, time - lag(time) OVER {WF} AS step FROM f)",
    "direction_cosines": _long(_BASE, "c", COSINES),
    "features_b": _long(_BASE, "c", TERMS["b"]),
    "features_c_central": _long(f"{_BASE}, {_rates('central')}", "r", TERMS["c"]),
    "features_c_causal": _long(f"{_BASE}, {_rates('causal')}", "r", TERMS["c"]),
    "features_d": _long(f"{_BASE}, {_rates('central')}", "r", TERMS["d"]),
    "features_imu": _long(f"{_BASE}, {_rates('imu')}", "r", TERMS["d"]),
    "features_c_in_segments": _long(f"{_BASE}, {_SEG}, {_rates('central', '(PARTITION BY flight_id, seg_ord ORDER BY row_idx)', 's')}", "r", TERMS["c"]),
    "heading_ref": f"WITH {_BASE}, {_REF} SELECT flight_id, round(ref, 6) + 0.0 AS reference_deg, round(n, 6) + 0.0 AS centre_N, round(e, 6) + 0.0 AS centre_E, round(s, 6) + 0.0 AS centre_S, round(w, 6) + 0.0 AS centre_W FROM centres",
    "heading_bin": f"WITH {_BINNED} SELECT flight_id, row_idx, bin FROM b",
    "attitude_rate_rows": f"WITH {_RATED} SELECT flight_id, row_idx, round(pitch_deg_s, 6) + 0.0 AS pitch_deg_s, round(roll_deg_s, 6) + 0.0 AS roll_deg_s, round(yaw_deg_s, 6) + 0.0 AS yaw_deg_s FROM rated",
    "yaw_unwrap": f"WITH {_BINNED}, {_TURNED} SELECT flight_id, row_idx, round(heading_unwrapped, 6) + 0.0 AS heading_unwrapped FROM turned",
    "maneuver_label": f"WITH {_RATED} SELECT flight_id, row_idx, maneuver FROM lab",
    "segments_explicit": f"WITH {_BASE}, {_SEG} SELECT flight_id, seg_ord, seg_maneuver AS maneuver, seg_heading AS heading, CAST(min(row_idx) AS INT) AS start_idx, CAST(max(row_idx) + 1 AS INT) AS end_idx FROM s GROUP BY ALL",
    "segments_auto": f"""WITH {_RATED}, m AS (SELECT *, CASE WHEN lag(row_idx) OVER {WF} IS NOT NULL AND maneuver IS NOT DISTINCT FROM lag(maneuver) OVER {WF} AND bin IS NOT DISTINCT FROM lag(bin) OVER {WF} THEN 0 ELSE 1 END AS fresh FROM lab),
s AS (SELECT *, CAST(sum(fresh) OVER {WF} AS INT) AS seg_ord FROM m) SELECT flight_id, seg_ord, maneuver, bin AS heading, CAST(min(row_idx) AS INT) AS start_idx, CAST(max(row_idx) + 1 AS INT) AS end_idx FROM s WHERE bin IS NOT NULL GROUP BY ALL""",
    "steady_mask": f"WITH {_BASE}, {_SEG} SELECT flight_id, row_idx, seg_maneuver = 'steady' AS steady FROM s",
    "delta_b_steady": f"WITH {_DELTA} SELECT flight_id, row_idx, round(delta_B, 6) + 0.0 AS delta_B FROM d",
    "delta_b_all": f"WITH {_BASE} SELECT flight_id, row_idx, round(B_total - avg(B_total) OVER (PARTITION BY flight_id), 6) + 0.0 AS delta_B FROM f",
    "gram_b": f"WITH {_DELTA}, {_gram(TERMS['b'], source='d')}",
    "gram_c": f"WITH {_DELTA}, {_rates('central', '(PARTITION BY flight_id, seg_ord ORDER BY row_idx)', 'd')}, {_gram(TERMS['c'])}",
    "gram_by_heading": f"WITH {_DELTA}, {_gram(TERMS['a'], 'seg_heading', 'd')}",
    "gram_by_maneuver": f"WITH {_DELTA}, {_gram(TERMS['a'], 'seg_maneuver', 'd')}",
    "ols_a": _coefficients(_fit()),
    "ridge_a": _coefficients(_fit(alpha="25.0")),
    "ols_a_by_flight": _coefficients(_fit("flight_id"), "flight_id", "flight_id"),
    "ols_a_by_heading": _coefficients(_fit("seg_heading"), "seg_heading", "heading"),
    "ols_a_by_maneuver": _coefficients(_fit("seg_maneuver"), "seg_maneuver", "maneuver"),
    "vif_a": _vif(),
    "lasso_a": _descent(f"{_LASSO / 2!r}", "0.0"),
    "elastic_net_a": _descent(f"{_LASSO / 4!r}", f"{_LASSO / 4!r}"),
    "ridge_cv_a": _ridge_cv(),
    "lasso_cv_a": _elastic_cv(1.0),
    "elastic_net_cv_a": _elastic_cv(0.5),
    "effective_dof_a": _dof(),
    "condition_a": _condition(),
    "auto_ridge_c": f"WITH {_DELTA} SELECT count(*) AS n, 0.001::DOUBLE AS selected_alpha, 18 AS n_terms FROM d",
    "model_field": _dipole(DIPOLE[1, 0], DIPOLE[1, 1], DIPOLE[1, -1]),
    "compensate_c": f"""WITH RECURSIVE {_DELTA}, {_rates('central', '(PARTITION BY flight_id, seg_ord ORDER BY row_idx)', 'd')}, {_solved(TERMS['c'])},
x AS (SELECT flight_id, row_idx, B_total, cos_x, cos_y, cos_z, {', '.join(f'{_central(c, WF)} AS {r}' for c, r in zip(COSINES, RATES))} FROM c)
SELECT flight_id, row_idx, round(B_total - ({' + '.join(f'w[{i + 1}] * {_product(t)}' for i, t in enumerate(TERMS['c']))}), 3) + 0.0 AS tmi_compensated FROM x, w""",
    "residuals_a": f"WITH {_FOM} SELECT flight_id, seg_ord, row_idx, round(residual, 6) + 0.0 AS residual FROM res",
    "compensate_a": f"WITH {_fit()} SELECT flight_id, row_idx, round(B_total - {_MODEL}, 6) + 0.0 AS tmi_compensated FROM d, w",
    "compensate_by_flight_a": f"WITH {_fit('flight_id')} SELECT flight_id, row_idx, round(B_total - {_MODEL}, 6) + 0.0 AS tmi_compensated FROM d JOIN w USING (flight_id)",
    "compensate_heading_a": f"""WITH {_fit('seg_heading')}, folded AS (SELECT ((degrees(atan2(avg(sin(radians(((heading % 90) + 90) % 90))), avg(cos(radians(((heading % 90) + 90) % 90))))) % 90) + 90) % 90 AS ref FROM f),
spokes AS (SELECT ref, k, (ref + 90.0 * k) % 360 AS spoke FROM folded, (SELECT unnest([0, 1, 2, 3]) AS k)),
k0 AS (SELECT arg_min(k, least(spoke, 360 - spoke) * 10 + k * 1e-9) AS k0 FROM spokes),
named AS (SELECT spoke, ['N', 'E', 'S', 'W'][(k - k0 + 4) % 4 + 1] AS h FROM spokes, k0),
near AS (SELECT flight_id, row_idx, arg_min(h, {_away('heading', 'spoke')} * 10 + CASE h WHEN 'N' THEN 0 WHEN 'E' THEN 1e-9 WHEN 'S' THEN 2e-9 ELSE 3e-9 END) AS h FROM d, named WHERE h IN (SELECT seg_heading FROM w) GROUP BY flight_id, row_idx)
SELECT d.flight_id, d.row_idx, round(B_total - {_MODEL}, 6) + 0.0 AS tmi_compensated FROM d JOIN near USING (flight_id, row_idx) JOIN w ON w.seg_heading = near.h""",
    "compensate_adaptive_a": f"""WITH {_fit('seg_maneuver')}, {_VARS} d),
share AS (SELECT *, vx + vy + vz + 0.1 AS total FROM v), parts AS (SELECT flight_id, row_idx, B_total, CASE w.seg_maneuver WHEN 'pitch' THEN vx WHEN 'roll' THEN vy WHEN 'yaw' THEN vz ELSE 0.1 END / total * {_MODEL} AS part FROM share, w)
SELECT flight_id, row_idx, round(any_value(B_total) - sum(part), 6) + 0.0 AS tmi_compensated FROM parts GROUP BY flight_id, row_idx""",
    "rolling_variances": f"WITH {_BASE}, {_VARS} c) SELECT flight_id, row_idx, round(vx, 9) + 0.0 AS var_x, round(vy, 9) + 0.0 AS var_y, round(vz, 9) + 0.0 AS var_z FROM v",
    "blending_weights": f"WITH {_BASE}, {_VARS} c) SELECT flight_id, row_idx, round(vx / (vx + vy + vz + 0.1), 8) + 0.0 AS w_pitch, round(vy / (vx + vy + vz + 0.1), 8) + 0.0 AS w_roll, round(vz / (vx + vy + vz + 0.1), 8) + 0.0 AS w_yaw, round(0.1 / (vx + vy + vz + 0.1), 8) + 0.0 AS w_steady FROM v",
    "fom_by_maneuver": f"WITH {_FOM} SELECT seg_maneuver AS maneuver, {_RMS} FROM res GROUP BY 1",
    "fom_by_heading": f"WITH {_FOM} SELECT seg_heading AS heading, {_RMS} FROM res GROUP BY 1",
    "fom_ratio": f"WITH {_FOM} SELECT count(*) AS n_samples, round(stddev_pop(delta_B) / stddev_pop(residual), 5) + 0.0 AS improvement_ratio FROM res",
    "fom_by_flight": f"WITH {_FOM} SELECT flight_id, coalesce(seg_maneuver, '-') AS maneuver, coalesce(seg_heading, '-') AS heading, {_RMS} FROM res GROUP BY GROUPING SETS ((flight_id, seg_maneuver), (flight_id, seg_heading), (flight_id))",
    "rls_result_a": f"WITH {_fit('flight_id', '1e-6')} SELECT flight_id, round(stddev_pop({_MODEL} - delta_B), 4) AS spread, count(*) AS n FROM d JOIN (SELECT flight_id, w0, w1, w2 FROM w) USING (flight_id) GROUP BY flight_id",
    "rls_a_lambda1": _rls(1.0),
    "rls_a_forget": _rls(0.98),
}
