"""The optimum of the balanced elastic net in SQL: proximal gradient steps in a recursive query.

An answer that shares nothing with the fits it checks: rows are collapsed, scaled and weighted
per training part in SQL, every (part, C) is a row of the recursion, and each step takes the
gradient of all of them from one aggregate over the rows. Momentum is constant, and the steps
are many more than ten decimal places need.
"""

from __future__ import annotations

from collections.abc import Sequence

STEPS = 700
MOMENTUM = 0.9
GRID = (0.01, 0.1, 1.0, 10.0)


def slots_sql(source: str = "rows", key: str = "id") -> str:
    """``layout``, the outer and inner fold counts of each group of ``source(grp, label, ...)``, and ``slotted``, its rows with
    their fold slots, from their places in the hash order of their label."""
    return f"""layout AS MATERIALIZED (SELECT grp, CAST(greatest(2, least(5, min(nc), sum(nc) // 2)) AS BIGINT) AS k, CAST(greatest(2, least(3, min(nc))) AS BIGINT) AS inner_k
  FROM (SELECT grp, label, count(*) AS nc FROM {source} GROUP BY 1, 2) GROUP BY 1),
slotted AS (SELECT r.*, (row_number() OVER (PARTITION BY r.grp, label ORDER BY md5('42:' || CAST({key} AS VARCHAR)), {key}) - 1) % (k * inner_k) AS slot
  FROM {source} r JOIN layout l ON l.grp = r.grp)"""


def collapsed_sql(columns: Sequence[str], positive: str, source: str = "slotted") -> str:
    """Equal rows as one: the matrix row ``x``, the class ``y``, the slot and the count."""
    x = ", ".join(f"CAST({c} AS DOUBLE)" for c in columns)
    return f"""m AS MATERIALIZED (SELECT grp, [{x}] AS x, CASE WHEN label = '{positive}' THEN 1 ELSE 0 END AS y, slot, count(*) AS n FROM {source} GROUP BY ALL)"""


def fits_sql(d: int, grid: Sequence[float] = GRID, outer: bool = True, inner: bool = True, steps: int = STEPS) -> str:
    """CTEs from ``m`` to ``fits(grp, f, g, c, b, mu, sd)``: coefficients of scaled columns, the centred intercept last.

    ``f`` and ``g`` are the outer and inner fold left out, -1 for none.
    """
    js = range(1, d + 1)
    mean = ", ".join(f"sum(n * x[{j}]) / sum(n)" for j in js)
    square = ", ".join(f"sum(n * x[{j}] * x[{j}]) / sum(n)" for j in js)
    spread = ", ".join(f"CASE WHEN sq[{j}] - mu[{j}] * mu[{j}] > 1e-12 * greatest(1.0, mu[{j}] * mu[{j}]) THEN sqrt(sq[{j}] - mu[{j}] * mu[{j}]) ELSE 1.0 END" for j in js)
    scaled = ", ".join(f"(x[{j}] - mu[{j}]) / sd[{j}]" for j in js)
    margin = " + ".join(f"a[{j}] * v[{j}]" for j in range(1, d + 2))
    norm = " + ".join(f"a[{j}] * a[{j}]" for j in range(1, d + 2))
    moved = [f"any_value(v[{j}]) - any_value(step) * (sum(r * a[{j}]) / any_value(tw)" + (f" + any_value(l1) * any_value(v[{j}]))" if j <= d else ")") for j in range(1, d + 2)]
    shrunk = ", ".join(f"sign(u[{j}]) * greatest(abs(u[{j}]) - step * l1, 0.0)" for j in js) + f", u[{d + 1}]"
    ahead = ", ".join(f"nb[{j}] + {MOMENTUM} * (nb[{j}] - b[{j}])" for j in range(1, d + 2))
    cs = ", ".join(f"({c}::DOUBLE)" for c in grid)
    zeros = f"list_transform(range({d + 1}), lambda q: 0.0::DOUBLE)"
    return f"""place AS MATERIALIZED (SELECT grp, k, f, g, slot, (f = -1 OR slot % k <> f) AS inside,
    CASE WHEN f = -1 THEN slot % inner_k ELSE (slot - (slot + k - 1 - f) // k) % inner_k END AS fold
  FROM layout, range(-1, {"k" if outer else "0"}) t(f), range(-1, {"inner_k" if inner else "0"}) u(g), range(k * inner_k) s(slot)),
train AS MATERIALIZED (SELECT m.grp, f, g, x, y, sum(n) AS n FROM m JOIN place ON m.slot = place.slot AND m.grp = place.grp WHERE inside AND (g = -1 OR fold <> g) GROUP BY ALL),
sizes AS (SELECT grp, f, g, y, sum(n) AS ny, sum(sum(n)) OVER (PARTITION BY grp, f, g) AS total, count(*) OVER (PARTITION BY grp, f, g) AS k FROM train GROUP BY grp, f, g, y),
moments AS (SELECT grp, f, g, [{mean}] AS mu, [{square}] AS sq FROM train GROUP BY grp, f, g),
scales AS (SELECT grp, f, g, mu, [{spread}] AS sd FROM moments),
ready AS MATERIALIZED (SELECT t.grp, t.f, t.g, t.y, t.n * s.total / (s.k * s.ny) AS w, [{scaled}, 1.0::DOUBLE] AS a
  FROM train t JOIN sizes s ON t.grp = s.grp AND t.f = s.f AND t.g = s.g AND t.y = s.y JOIN scales c ON c.grp = t.grp AND c.f = t.f AND c.g = t.g),
bounds AS (SELECT grp, f, g, sum(w) AS tw, 0.25 * sum(w * ({norm})) / sum(w) AS bend FROM ready GROUP BY grp, f, g),
jobs AS MATERIALIZED (SELECT grp, f, g, c, tw, 0.5 / (c * tw) AS l1, 1.0 / (bend + 0.5 / (c * tw)) AS step FROM bounds, (VALUES {cs}) h(c)),
steps AS (SELECT grp, f, g, c, 0 AS i, {zeros} AS b, {zeros} AS v FROM jobs
  UNION ALL SELECT grp, f, g, c, i + 1, nb, [{ahead}] FROM (SELECT grp, f, g, c, i, b, [{shrunk}] AS nb FROM (
    SELECT s.grp, s.f, s.g, s.c, any_value(i) AS i, any_value(b) AS b, any_value(l1) AS l1, any_value(step) AS step, [{", ".join(moved)}] AS u FROM (
      SELECT s.grp, s.f, s.g, s.c, i, b, v, l1, step, tw, a, w * (1.0 / (1.0 + exp(-({margin}))) - y) AS r
      FROM steps s JOIN jobs j ON s.grp = j.grp AND s.f = j.f AND s.g = j.g AND s.c = j.c JOIN ready z ON z.grp = s.grp AND z.f = s.f AND z.g = s.g WHERE i < {steps}) s
    GROUP BY s.grp, s.f, s.g, s.c))),
fits AS MATERIALIZED (SELECT s.grp, s.f, s.g, s.c, b, mu, sd FROM steps s JOIN scales t ON s.grp = t.grp AND s.f = t.f AND s.g = t.g WHERE i = {steps})"""


def margin_sql(d: int) -> str:
    """Margin of a row ``x`` under a fit; one as good as 0 is 0."""
    z = " + ".join(f"b[{j}] * (x[{j}] - mu[{j}]) / sd[{j}]" for j in range(1, d + 1)) + f" + b[{d + 1}]"
    return f"CASE WHEN abs({z}) > 1e-9 THEN {z} ELSE 0.0 END"


def chosen_sql(d: int) -> str:
    """``scores`` of every fit on its held-out rows, and ``chosen(grp, f, c)``, the best C of each outer part."""
    return f"""scores AS (SELECT t.grp, t.f, t.g, t.c, sum(CASE WHEN ({margin_sql(d)} > 0) = (y = 1) THEN n ELSE 0 END) / sum(n) AS score
  FROM fits t JOIN place p ON p.grp = t.grp AND p.f = t.f AND p.g = t.g JOIN m ON m.slot = p.slot AND m.grp = t.grp
  WHERE CASE WHEN p.g = -1 THEN p.f <> -1 AND p.slot % p.k = p.f ELSE inside AND fold = p.g END GROUP BY t.grp, t.f, t.g, t.c),
means AS (SELECT grp, f, c, round(avg(score), 12) AS score FROM scores WHERE g <> -1 GROUP BY grp, f, c),
chosen AS (SELECT grp, f, c FROM means QUALIFY row_number() OVER (PARTITION BY grp, f ORDER BY score DESC, c) = 1)"""
