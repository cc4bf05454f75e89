"""SQL of iterative fits: penalised logistic and linear models over folds, and random intercepts.

Matrices are nested lists; cross-products come from unnested index pairs, and linear systems are
solved by sweeping one variable after another in a recursive relation.
"""

from __future__ import annotations

RIDGE = 0.01
STEPS = 8
RATIO_ZOOMS = 4
RATIO_STEPS = 3
STENCIL = 0.05  # between the seven points that a Newton step on the ratio looks at


def pairs(source: str, n: int) -> str:
    """``source`` with every index pair from 1 to n."""
    span = f"unnest(range(1, {n + 1}))"
    return f"(SELECT *, {span} AS j FROM (SELECT *, {span} AS i FROM {source}))"


def matrix(source: str, key: str, value: str = "c") -> str:
    """Nested lists ``m`` per key from a relation with i, j and a value."""
    return (
        f"(SELECT {key}, list(r ORDER BY i) AS m FROM (SELECT {key}, i, list({value} ORDER BY j) AS r FROM {source}"
        f" GROUP BY {key}, i) GROUP BY {key})"
    )


def swept(m: str, at: str, n: int) -> str:
    """The matrix after a sweep of variable ``at``."""
    span = f"range(1, {n + 1})"
    return f"""list_transform({span}, lambda a: list_transform({span}, lambda b:
        CASE WHEN a = {at} AND b = {at} THEN -1 / {m}[{at}][{at}]
             WHEN a = {at} OR b = {at} THEN {m}[a][b] / {m}[{at}][{at}]
             ELSE {m}[a][b] - {m}[a][{at}] * {m}[{at}][b] / {m}[{at}][{at}] END))"""


def ridge_fit(tag: str, source: str, p: int) -> str:
    """CTEs ending in ``fit<tag>``: penalised fits of element p + 1 of ``v`` on the others, by ``k``, weights ``w``."""
    n = p + 1
    return f""", mean{tag} AS MATERIALIZED (
  SELECT k, list(a ORDER BY i) AS centre, any_value(n) AS n FROM (
    SELECT k, i, sum(w * v[i]) / sum(w) AS a, count(*) AS n FROM (SELECT *, unnest(range(1, {n + 1})) AS i FROM {source}) GROUP BY k, i)
  GROUP BY k),
gap{tag} AS MATERIALIZED (
  SELECT k, w, list_transform(range(1, {n + 1}), lambda i: v[i] - centre[i]) AS d FROM {source} JOIN mean{tag} USING (k)),
cross{tag} AS (SELECT k, i, j, sum(w * d[i] * d[j]) AS c FROM {pairs(f'gap{tag}', n)} GROUP BY k, i, j),
start{tag} AS MATERIALIZED (
  SELECT k, m FROM {matrix(f'(SELECT k, i, j, c + CASE WHEN i = j AND i <= {p} THEN {RIDGE} * n ELSE 0 END AS c FROM cross{tag} JOIN mean{tag} USING (k))', 'k')}),
sweep{tag} AS (
  SELECT 0 AS s, k, m FROM start{tag}
  UNION ALL
  SELECT s + 1, k, {swept('m', '(s + 1)', n)} FROM sweep{tag} WHERE s < {p}),
fit{tag} AS MATERIALIZED (
  SELECT k, n, centre[1:{p}] AS centre, slopes, centre[{n}] - list_dot_product(slopes, centre[1:{p}]) AS intercept,
         list_transform(m[1:{p}], lambda r: list_transform(r[1:{p}], lambda x: -x)) AS inverse,
         greatest(m[{n}][{n}] - {RIDGE} * n * list_dot_product(slopes, slopes), 0)
           / (n - 1 - {p} + {RIDGE} * n * -list_sum(list_transform(range(1, {n}), lambda i: m[i][i]))) AS variance
  FROM (SELECT k, m, list_transform(range(1, {n}), lambda i: m[i][{n}]) AS slopes FROM sweep{tag} WHERE s = {p})
  JOIN mean{tag} USING (k))
"""


def cross_fitted(frame: str, terms: dict[str, str], y: str, t: str, clip: float = 0.01) -> str:
    """CTEs ending in ``scored``: two folds by caseid, Newton steps, a surface per arm."""
    p = len(terms)
    columns = ", ".join(f"CAST({e} AS DOUBLE)" for e in terms.values())
    out = f""", cx AS MATERIALIZED (
  SELECT caseid, bl, {t} AS t, {y} AS y, CAST(caseid % 10007 * 7919 % 10007 % 2 AS INTEGER) AS fold, [{columns}] AS x FROM {frame}),
scale AS MATERIALIZED (
  SELECT list(a ORDER BY i) AS a, list(s ORDER BY i) AS s FROM (
    SELECT i, avg(x[i]) AS a, stddev_pop(x[i]) AS s FROM (SELECT x, unnest(range(1, {p + 1})) AS i FROM cx) GROUP BY i)),
zz AS MATERIALIZED (
  SELECT caseid, bl, t, y, fold, list_transform(range(1, {p + 1}), lambda i:
    CASE WHEN s[i] > 1e-9 * (1 + abs(a[i])) THEN (x[i] - a[i]) / s[i] ELSE 0 END) AS z FROM cx, scale),
beta0 AS (SELECT k, 0.0::DOUBLE AS intercept, list_transform(range({p}), lambda i: 0.0::DOUBLE) AS slopes FROM (VALUES (0), (1)) AS f(k))
"""
    for step in range(STEPS):
        previous = "beta0" if step == 0 else f"fit_l{step - 1}"
        out += f""", work{step} AS MATERIALIZED (
  SELECT k, w, list_append(z, eta + (t - e) / w) AS v FROM (
    SELECT *, greatest(e * (1 - e), 1e-10) AS w FROM (
      SELECT *, 1 / (1 + exp(-eta)) AS e FROM (
        SELECT k, z, t, intercept + list_dot_product(z, slopes) AS eta FROM zz JOIN {previous} ON k = 1 - fold))))
""" + ridge_fit(f"_l{step}", f"work{step}", p)
    out += """, arms AS MATERIALIZED (SELECT 2 * (1 - fold) + t AS k, 1.0::DOUBLE AS w, list_append(z, y) AS v FROM zz)
""" + ridge_fit("_s", "arms", p)

    def arm(a: int) -> str:
        gap = f"list_transform(range(1, {p + 1}), lambda i: z[i] - s{a}.centre[i])"
        return f"""s{a}.intercept + list_dot_product(z, s{a}.slopes) AS mu{a},
         sqrt(s{a}.variance * (1.0 / s{a}.n + list_sum(list_transform(range(1, {p + 1}), lambda i:
           (z[i] - s{a}.centre[i]) * list_dot_product({gap}, s{a}.inverse[i]))))) AS sd{a}"""

    return out + f""", raw AS MATERIALIZED (
  SELECT caseid, bl, t AS treatment, y, fold, 1 / (1 + exp(-(l.intercept + list_dot_product(z, l.slopes)))) AS e0, {arm(1)}, {arm(0)}
  FROM zz JOIN fit_l{STEPS - 1} l ON l.k = fold JOIN fit_s s1 ON s1.k = 2 * fold + 1 JOIN fit_s s0 ON s0.k = 2 * fold),
scored AS MATERIALIZED (
  SELECT *, CASE WHEN e0 < {clip} OR e0 > {1 - clip} THEN 1 ELSE 0 END AS clipped, least(greatest(e0, {clip}), {1 - clip}) AS e FROM raw),
cut AS (SELECT max(CASE WHEN treatment = 1 THEN sd1 END) + coalesce(stddev_samp(CASE WHEN treatment = 1 THEN sd1 END), 0) AS c1,
               max(CASE WHEN treatment = 0 THEN sd0 END) + coalesce(stddev_samp(CASE WHEN treatment = 0 THEN sd0 END), 0) AS c0 FROM scored),
trimmed AS MATERIALIZED (
  SELECT scored.*, CASE WHEN (treatment = 1 AND sd0 <= c1) OR (treatment = 0 AND sd1 <= c0) THEN 1 ELSE 0 END AS supported FROM scored, cut),
kept AS MATERIALIZED (SELECT * FROM trimmed WHERE supported = 1)
"""


def ratio_average(value: str, weight: str) -> str:
    """CTEs ending in ``res``: ``sum(value) / sum(weight)`` over ``kept``, errors added up within persons."""
    return f""", v AS (SELECT caseid, clipped, {value} AS val, {weight} AS wt FROM kept),
est AS (SELECT sum(val) / sum(wt) AS est, sum(wt) AS total, count(CASE WHEN wt <> 0 THEN 1 END) AS n_rows, sum(clipped) AS n_clipped,
               count(DISTINCT CASE WHEN wt <> 0 THEN caseid END) AS n_persons FROM v),
per AS (SELECT caseid, sum(val - wt * est) AS psi FROM v, est GROUP BY caseid),
res AS (SELECT any_value(est) AS est, sqrt(sum(psi * psi)) / any_value(total) AS sd, any_value(n_rows) AS n_rows,
               any_value(n_persons) AS n_persons, any_value(n_clipped) AS n_clipped FROM per, est)
"""


def bootstrap(cuts: list[int], replicates: int) -> str:
    """CTEs ending in ``drawn``: the effect on the treated, persons counted as their hash says."""
    count = " + ".join(f"CASE WHEN h >= {c} THEN 1 ELSE 0 END" for c in cuts)
    return f""", person AS (SELECT caseid, sum(treatment * (mu1 - mu0)) AS a, sum(treatment) AS b FROM kept GROUP BY caseid),
hashed AS (SELECT a, b, r, CAST('0x' || substring(md5(caseid || ':' || r), 1, 8) AS BIGINT) AS h FROM person, (SELECT unnest(range(1, {replicates + 1})) AS r)),
draw AS (SELECT r, sum(({count}) * a) / sum(({count}) * b) AS estimate FROM hashed GROUP BY r),
drawn AS (SELECT avg(estimate) AS est, stddev_samp(estimate) AS sd, count(estimate) AS n_draws FROM draw)
"""


def random_intercept(frame: str, terms: dict[str, str], y: str, group: str) -> str:
    """CTEs ending in ``best``: restricted maximum likelihood with an intercept per ``group``.

    Needs ``fit`` with the terms ``kept``. The logarithm of the variance ratio is found by zooming in
    on a grid and then by Newton steps on the criterion's differences.
    """
    p = len(terms)
    n = p + 2  # the intercept, the terms, the outcome
    columns = [f"CAST({e} AS DOUBLE)" for e in (*terms.values(), y)]
    complete = " AND ".join(f"({e}) IS NOT NULL" for e in (*terms.values(), y))
    out = f""", rr AS MATERIALIZED (SELECT {group} AS g, [{', '.join(columns)}] AS x FROM {frame} WHERE {complete}),
rm AS MATERIALIZED (SELECT list(a ORDER BY i) AS centre FROM (SELECT i, avg(x[i]) AS a FROM (SELECT x, unnest(range(1, {p + 2})) AS i FROM rr) GROUP BY i)),
rd AS MATERIALIZED (SELECT g, list_prepend(1.0::DOUBLE, list_transform(range(1, {p + 2}), lambda i: x[i] - centre[i])) AS d FROM rr, rm),
gv AS MATERIALIZED (SELECT g, any_value(size) AS size, list(s ORDER BY i) AS v FROM (
  SELECT g, i, sum(d[i]) AS s, count(*) AS size FROM (SELECT *, unnest(range(1, {n + 1})) AS i FROM rd) GROUP BY g, i) GROUP BY g),
whole AS MATERIALIZED (SELECT i, j, sum(d[i] * d[j]) AS c FROM {pairs('rd', n)} GROUP BY i, j),
bysize AS MATERIALIZED (SELECT size, i, j, sum(v[i] * v[j]) AS c FROM {pairs('gv', n)} GROUP BY size, i, j),
sizes AS MATERIALIZED (SELECT size, count(*) AS cnt FROM gv GROUP BY size),
used AS MATERIALIZED (SELECT list_concat([1], list_transform(kept, lambda i: i + 1)) AS use, (SELECT count(*) FROM rr) AS n_rows FROM fit)
"""

    def criterion(tag: str, source: str) -> str:
        """``crit<tag>`` for every (t, th) of ``source``."""
        return f""", mat{tag} AS MATERIALIZED {matrix(f'''(
    SELECT t, whole.i AS i, whole.j AS j, any_value(whole.c) - sum(th / (1 + size * th) * bysize.c) AS c
    FROM {source}, whole JOIN bysize ON bysize.i = whole.i AND bysize.j = whole.j GROUP BY t, whole.i, whole.j)''', 't')},
log{tag} AS (SELECT t, any_value(th) AS th, sum(cnt * ln(1 + size * th)) AS logs FROM {source}, sizes GROUP BY t),
swp{tag} AS (
  SELECT 1 AS s, t, m, 0.0::DOUBLE AS ld FROM mat{tag}
  UNION ALL
  SELECT s + 1, t, {swept('m', 'use[s]', n)}, ld + ln(m[use[s]][use[s]]) FROM swp{tag}, used WHERE s <= len(use)),
crit{tag} AS MATERIALIZED (
  SELECT t, th, m, use, m[{n}][{n}] / (n_rows - len(use)) AS variance, n_rows,
         (n_rows - len(use)) * ln(m[{n}][{n}] / (n_rows - len(use))) + logs + ld AS value
  FROM swp{tag} JOIN log{tag} USING (t), used WHERE s = len(use) + 1)
"""

    here = "(SELECT -2.0::DOUBLE AS t, 10.0::DOUBLE AS half)"
    for z in range(RATIO_ZOOMS):
        out += f""", grid_z{z} AS MATERIALIZED (SELECT t, exp(t) AS th FROM (
  SELECT t + half * (q - 10) / 10 AS t FROM {here}, (SELECT unnest(range(21)) AS q)))
""" + criterion(f"_z{z}", f"grid_z{z}") + f""", at_z{z} AS MATERIALIZED (SELECT arg_min(t, value) AS t, {10.0 / 10 ** (z + 1)}::DOUBLE AS half FROM crit_z{z})
"""
        here = f"at_z{z}"
    place = f"at_z{RATIO_ZOOMS - 1}"
    first = "-f[1] + 9 * f[2] - 45 * f[3] + 45 * f[5] - 9 * f[6] + f[7]"
    second = "2 * f[1] - 27 * f[2] + 270 * f[3] - 490 * f[4] + 270 * f[5] - 27 * f[6] + 2 * f[7]"
    for s in range(RATIO_STEPS):
        out += f""", grid_n{s} AS MATERIALIZED (SELECT t, exp(t) AS th FROM (
  SELECT t + {STENCIL} * (q - 3) AS t FROM {place}, (SELECT unnest(range(7)) AS q)))
""" + criterion(f"_n{s}", f"grid_n{s}") + f""", at_n{s} AS MATERIALIZED (
  SELECT f0.t - ({first}) / (60 * {STENCIL}) / (({second}) / (180 * {STENCIL} * {STENCIL})) AS t
  FROM (SELECT list(value - (SELECT min(value) FROM crit_n{s}) ORDER BY t) AS f FROM crit_n{s}), {place} f0)
"""
        place = f"at_n{s}"
    out += f", grid_e AS MATERIALIZED (SELECT t, exp(t) AS th FROM {place} UNION ALL SELECT -999, 0)\n" + criterion("_e", "grid_e")
    return out + ", best AS MATERIALIZED (SELECT crit_e.*, rm.centre FROM crit_e, rm ORDER BY value LIMIT 1)\n"


def random_intercept_rows(terms: dict[str, str]) -> str:
    """One relation with pos, term, estimate and se from ``best``."""
    p = len(terms)
    n = p + 2
    shift = "CASE WHEN {0} = 1 THEN 1 ELSE -centre[{0} - 1] END"
    spread = (
        "list_sum(list_transform(use, lambda i: list_sum(list_transform(use, lambda j:"
        f" -m[i][j] * ({shift.format('i')}) * ({shift.format('j')})))))"
    )
    parts = [
        f"SELECT 0 AS pos, '(intercept)' AS term, centre[{p + 1}] + list_sum(list_transform(use, lambda i: m[i][{n}] * ({shift.format('i')}))) AS estimate,"
        f" sqrt(variance * {spread}) AS se FROM best"
    ]
    for j, term in enumerate(terms, start=1):
        held = f"list_contains(use, {j + 1})"
        parts.append(
            f"SELECT {j}, '{term}', CASE WHEN {held} THEN m[{j + 1}][{n}] END, CASE WHEN {held} THEN sqrt(-variance * m[{j + 1}][{j + 1}]) END FROM best"
        )
    return f"({' UNION ALL '.join(parts)})"
