"""SQL equivalents of the catalog queries, for a check in another engine.

They state each result directly from the base tables, in long form with joins and
windows, so they share no logic with the Spark side beyond the survey's definition.
"""

from __future__ import annotations

from panelwave.functions.recode import PRICE_INDEX
from panelwave.operators.effects import REPLICATES, poisson_cuts
from panelwave.plans import sql_fits

# --- the survey, one row per customer and quarter --------------------------------------

CELL = """
ord AS (
  SELECT o_custkey AS c, (year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) - 1 AS k,
         count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents,
         max(CASE WHEN o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
                  THEN 1 ELSE 0 END) AS inc
  FROM orders GROUP BY 1, 2),
grid AS (
  SELECT c_custkey AS c, c_nationkey AS nk, CAST(round(c_acctbal * 100) AS BIGINT) AS bal, k
  FROM customer, (SELECT unnest(range(27)) AS k)),
cell AS (
  SELECT g.c, g.nk, g.bal, g.k, coalesce(n, 0) AS n, cents, coalesce(inc, 0) AS inc,
         (g.c * 7 + g.k * 5) % 19 = 0 AS away,
         CASE WHEN g.k < 16 THEN 1979 + g.k ELSE 2 * (g.k + 982) END AS yr,
         (g.nk * 37 + g.k * 11 + g.c % 13) % 950 AS ind,
         10 + (g.c * 13 + g.k * 7) % 900 AS amt
  FROM grid g LEFT JOIN ord o ON o.c = g.c AND o.k = g.k),
"""

INCARCERATION = """
inca AS (
  SELECT c, k, inc AS incarcerated,
         CASE WHEN inc = 1 THEN 0 ELSE max(inc) OVER (PARTITION BY c ORDER BY k) END AS ever_inc
  FROM cell)
"""
WAGES = """
wag AS (
  SELECT c, k, wages, lead(wages) OVER (PARTITION BY c ORDER BY k) AS wages_lead
  FROM (SELECT c, k, CASE WHEN n > 0 THEN floor(cents / 10000) END AS wages FROM cell))
"""
INCOME = """
inco AS (
  SELECT c, k, income, lead(income) OVER (PARTITION BY c ORDER BY k) AS income_next
  FROM (SELECT c, k, CASE WHEN away OR (c + k) % 29 = 0 THEN NULL WHEN n > 0 AND (c + k) % 31 = 0 THEN -9
                          WHEN n > 0 THEN floor(cents / 1000) END AS income FROM cell))
"""
WORK = """
wrk AS (
  SELECT c, k, w, total, lag(total) OVER (PARTITION BY c ORDER BY k) AS lag_total
  FROM (SELECT c, k, w, sum(coalesce(w, 0)) OVER (PARTITION BY c ORDER BY k) AS total
        FROM (SELECT c, k, CASE WHEN NOT away THEN n * 9 END AS w FROM cell)))
"""
DRUG_ITEMS = """
items AS (
  SELECT c_custkey AS c, 'D11' AS stem, j, CASE WHEN (c_custkey + j) % 6 <> 0
         THEN CASE WHEN (c_custkey + j) % 11 = 0 THEN 1 ELSE 0 END END AS v
  FROM customer, (SELECT unnest(range(5)) AS j)
  UNION ALL
  SELECT c_custkey, 'D15', j, CASE WHEN (c_custkey + j) % 5 <> 0
         THEN CASE WHEN (c_custkey * 3 + j) % 13 = 0 THEN 1 ELSE 0 END END
  FROM customer, (SELECT unnest(range(5)) AS j)
  UNION ALL
  SELECT c_custkey, 'D19', j, CASE WHEN (c_custkey + j) % 7 <> 0
         THEN CASE WHEN (c_custkey + j) % 4 = 0 THEN 1 ELSE 0 END END
  FROM customer, (SELECT unnest(range(3)) AS j)
  UNION ALL
  SELECT c_custkey, 'DRUG', 1, CASE WHEN c_custkey % 23 = 0 THEN 1 ELSE 0 END FROM customer),
placed AS (
  SELECT c, v, stem, j,
         CASE WHEN stem = 'D19' THEN CASE j WHEN 0 THEN 13 WHEN 1 THEN 15 ELSE 19 END
              ELSE 5 END AS k,
         CASE WHEN stem = 'D19' THEN CASE j WHEN 0 THEN 13 WHEN 1 THEN 15 ELSE 19 END
              WHEN stem IN ('D11', 'D15')
              THEN CASE j WHEN 0 THEN 5 WHEN 1 THEN 9 WHEN 2 THEN 13 WHEN 3 THEN 15 ELSE 19 END
              ELSE 5 END AS kf
  FROM items),
drg AS (SELECT c, k, CASE WHEN sum(coalesce(v, 0)) > 0 THEN 1 ELSE 0 END AS drugs
        FROM placed GROUP BY c, k),
drgf AS (SELECT c, kf AS k, CASE WHEN sum(coalesce(v, 0)) > 0 THEN 1 ELSE 0 END AS drugs
         FROM placed GROUP BY c, kf)
"""
WELFARE = """
wel0 AS (
  SELECT c, k, yr, CASE WHEN away OR n > 0 THEN 0 WHEN (c + k) % 97 = 0 THEN amt * 50
                        WHEN (c + k) % 3 = 0 THEN amt ELSE 0 END AS welfare FROM cell),
wel AS (
  SELECT c, k, yr, CASE WHEN welfare <= 5 * (SELECT median(welfare) FROM wel0 WHERE welfare >= 1)
                        THEN welfare END AS welfare,
         CASE WHEN welfare < 1 THEN 0 ELSE 1 END AS welfare_indicator FROM wel0)
"""
STATIC = """
sta AS (
  SELECT c, nk % 3 + 1 AS race, s1 AS stopped80,
         CASE WHEN s2 IS NULL AND s1 IS NOT NULL THEN 0 ELSE s2 END AS charged80,
         CASE WHEN s3 IS NULL AND s1 IS NOT NULL THEN 0 ELSE s3 END AS convicted80,
         CASE WHEN s6 IS NULL AND s1 IS NOT NULL THEN 0 ELSE s6 END AS probation80,
         CASE WHEN s7 IS NULL AND s1 IS NOT NULL THEN 0 ELSE s7 END AS incarcerated80,
         CASE WHEN bal >= 0 THEN floor(bal / 10) END AS cog_ability,
         CASE WHEN nk % 3 = 1 THEN 1 ELSE 0 END AS black,
         CASE WHEN nk % 3 = 0 THEN 1 ELSE 0 END AS hispanic,
         c % 2 AS female
  FROM (SELECT c_custkey AS c, c_nationkey AS nk, CAST(round(c_acctbal * 100) AS BIGINT) AS bal,
               CASE WHEN c_custkey % 9 <> 0 THEN (c_custkey // 2) % 2 END AS s1,
               CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey // 4) % 2 END AS s2,
               CASE WHEN c_custkey % 4 <> 0 THEN CASE WHEN c_custkey % 10 = 1 THEN 1 ELSE 0 END END AS s3,
               CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN (c_custkey // 3) % 4 = 0 THEN 1 ELSE 0 END END AS s6,
               CASE WHEN c_custkey % 6 <> 0 THEN CASE WHEN (c_custkey // 5) % 8 = 0 THEN 1 ELSE 0 END END AS s7
        FROM customer))
"""

# One-cell recodes of the topics.
POVERTY = "CASE WHEN NOT (away OR (c + k) % 13 = 0) THEN (nk + k) % 2 END"
URBAN = "CASE WHEN NOT (away OR (c + k) % 17 = 0) THEN (c + k // 4) % 2 END"
EDYEARS = "CASE WHEN NOT away THEN 8 + least(k // 4, 3) + (c * 3 + c % 7) % 9 END"
ENROLLED = "CASE WHEN NOT away THEN CASE WHEN (c * 3 + k) % 4 IN (1, 2) THEN 1 ELSE 0 END END"
MARRIED = "CASE WHEN NOT away THEN CASE WHEN (c + k // 6) % 3 = 0 THEN 1 ELSE 0 END END"
REGION = "CASE WHEN NOT away THEN 1 + nk % 4 END"
AGE = "CASE WHEN NOT away THEN 16 + c % 8 + yr - 1979 END"
UNION = (
    "CASE WHEN CASE WHEN n > 1 THEN 1 ELSE 0 END"
    " + CASE WHEN NOT away AND (nk + k) % 3 = 0 THEN 1 ELSE 0 END > 0 THEN 1 ELSE 0 END"
)
PSECTOR = (
    "CASE WHEN away THEN 0 WHEN k < 15 AND (nk + k) % 3 = 1 THEN 1"
    " WHEN k >= 15 AND (nk + k) % 3 = 0 THEN 1 ELSE 0 END"
)
INDUSTRY = """CASE WHEN n = 0 THEN NULL WHEN ind BETWEEN 67 AND 398 THEN 1 WHEN ind <= 57 THEN 2
  WHEN ind BETWEEN 407 AND 479 THEN 3 WHEN ind BETWEEN 507 AND 698 THEN 4
  WHEN ind BETWEEN 707 AND 898 THEN 5 ELSE 6 END"""
ESR = """CASE WHEN away THEN NULL WHEN n > 1 THEN 1 WHEN n = 1 THEN 2 WHEN (c + k) % 5 = 0 THEN 3
  WHEN (c + k) % 31 = 0 THEN 8 ELSE 4 END"""
ESR_WAVES = "(k <= 17 OR k = 21)"


def flag(cond: str, known: str) -> str:
    return f"CASE WHEN {known} THEN CASE WHEN {cond} THEN 1 ELSE 0 END END"


EMPLOYED = flag(f"({ESR}) IN (1, 2)", f"({ESR}) IS NOT NULL")
UNEMPLOYED = flag(f"({ESR}) = 3", f"({ESR}) IS NOT NULL")
MILITARY = flag(f"({ESR}) = 8", f"({ESR}) IS NOT NULL")


def ints(**exprs: str) -> str:
    return ", ".join(f"CAST({e} AS INTEGER) AS {n}" for n, e in exprs.items())


def doubles(**exprs: str) -> str:
    return ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in exprs.items())


def from_cells(select: str, more: str = "", source: str = "cell", where: str = "true") -> str:
    head = "WITH " + CELL.strip().rstrip(",")
    if more:
        head += ", " + more
    return f"{head} SELECT {select} FROM {source} WHERE {where}"


KEYS = "CAST(c AS BIGINT) AS caseid, CAST(k AS INTEGER) AS wave"

STATIC_SELECT = ints(
    race="race", stopped80="stopped80", charged80="charged80", convicted80="convicted80",
    probation80="probation80", incarcerated80="incarcerated80",
) + ", " + doubles(cog_ability="cog_ability") + ", " + ints(
    black="black", hispanic="hispanic", female="female"
)

PANEL_CTES = ", ".join(
    part.strip() for part in (CELL.strip().rstrip(","), INCARCERATION, WAGES, INCOME, WORK, DRUG_ITEMS, WELFARE, STATIC)
)

PANEL = (
    "WITH RECURSIVE " + PANEL_CTES + ", panel AS (SELECT CAST(cell.c AS BIGINT) AS caseid, CAST(cell.k AS INTEGER) AS wave, "
    + ", ".join([
        ints(age=AGE, incarcerated="inca.incarcerated", ever_inc="inca.ever_inc"),
        doubles(wages="wag.wages", wages_lead="wag.wages_lead"),
        ints(drugs="drg.drugs", psector=PSECTOR, industry=INDUSTRY, region=REGION, year="cell.yr", married=MARRIED),
        f'CAST({UNION} AS INTEGER) AS "union"',
        doubles(weeks_worked="wrk.w", total_weeks_worked="wrk.total", lag_weeks_worked="wrk.lag_total"),
        ints(edyears=EDYEARS, enrolled=ENROLLED, urban=URBAN),
        doubles(income_past_year="inco.income", income_current_y="inco.income_next"),
        ints(pov_status=POVERTY),
        doubles(welfare="wel.welfare"),
        ints(
            welfare_indicator="wel.welfare_indicator",
            employed=f"CASE WHEN {ESR_WAVES} THEN {EMPLOYED} END",
            unemployed=f"CASE WHEN {ESR_WAVES} THEN {UNEMPLOYED} END",
            military=f"CASE WHEN {ESR_WAVES} THEN {MILITARY} END",
        ),
        STATIC_SELECT,
    ])
)
PANEL += """
  FROM cell LEFT JOIN inca USING (c, k) LEFT JOIN wag USING (c, k) LEFT JOIN drg USING (c, k)
  LEFT JOIN wrk USING (c, k) LEFT JOIN inco USING (c, k)
  LEFT JOIN (SELECT c AS wc, yr AS wyr, welfare, welfare_indicator FROM wel) wel ON wc = cell.c AND wyr = cell.yr
  LEFT JOIN (SELECT * RENAME (c AS sc) FROM sta) sta ON sc = cell.c)
"""

# --- samples ---------------------------------------------------------------------------

INDEX = "(VALUES " + ", ".join(f"({w}, {v}::DOUBLE)" for w, v in PRICE_INDEX.items()) + ") AS price(w, idx)"

FILLED = "last_value(drugs IGNORE NULLS) OVER (PARTITION BY caseid ORDER BY wave ROWS UNBOUNDED PRECEDING)"

SAMPLE_ONE = """, kept1 AS (
  SELECT * FROM panel WHERE female = 0 AND military = 0 AND wave > 3 AND wave < 18 AND wages > 0
    AND wages < 5 * (SELECT median(wages) FROM panel)),
filled1 AS (SELECT *, """ + FILLED + """ AS filled_drugs FROM kept1),
sample1 AS (
  SELECT f.* EXCLUDE (drugs, filled_drugs, cog_ability), f.cog_ability / 100 AS cog_ability,
         CASE WHEN wave = 4 AND filled_drugs IS NULL
              THEN (SELECT max(g.filled_drugs) FROM filled1 g WHERE g.caseid = f.caseid AND g.wave = 5)
              ELSE filled_drugs END AS drugs,
         ln(age) AS log_age, CAST(edyears * 10 AS INTEGER) AS education10,
         ln(lag_weeks_worked + 1) AS log_weeks, wages / idx AS wages_deflated,
         ln(wages / idx / 100) AS log_wages
  FROM filled1 f LEFT JOIN """ + INDEX + """ ON w = wave)
"""

SAMPLE_TWO = """, kept2 AS (
  SELECT * REPLACE (CASE WHEN income_current_y >= 0 THEN income_current_y END AS income_current_y,
                    CASE WHEN income_past_year >= 0 THEN income_past_year END AS income_past_year)
  FROM panel WHERE female = 0 AND wave > 3 AND wave < 23),
filled2 AS (SELECT *, """ + FILLED + """ AS filled_drugs FROM kept2),
sample2 AS (
  SELECT f.* EXCLUDE (drugs, filled_drugs, cog_ability, pov_status), f.cog_ability / 100 AS cog_ability,
         coalesce(pov_status, 0) AS pov_status,
         CASE WHEN wave = 4 AND filled_drugs IS NULL
              THEN (SELECT max(g.filled_drugs) FROM filled2 g WHERE g.caseid = f.caseid AND g.wave = 5)
              ELSE filled_drugs END AS drugs,
         ln(age) AS log_age, ln(lag_weeks_worked + 1) AS log_weeks,
         wages / coalesce(idx, 1) AS wages_deflated,
         income_current_y / idx AS income_current_y_d, income_past_year / idx AS income_past_year_d,
         ln(wages / coalesce(idx, 1) + 1) AS log_wages,
         ln(income_current_y / idx + 1) AS log_income_current_y,
         ln(income_past_year / idx + 1) AS log_income_past_y,
         coalesce(wages / coalesce(idx, 1), 0) AS wages_nas,
         coalesce(income_current_y / idx, 0) AS income_current_y_nas,
         coalesce(income_past_year / idx, 0) AS income_past_year_nas,
         coalesce(industry, 0) AS industry_nas, coalesce(urban, 2) AS urban_nas
  FROM filled2 f LEFT JOIN """ + INDEX + """ ON w = wave)
"""

COVARIATES = (
    "industry_nas", "union", "psector", "region", "married", "edyears", "enrolled", "urban_nas",
    "drugs", "age", "cog_ability", "stopped80", "charged80", "probation80", "convicted80",
    "total_weeks_worked", "welfare_indicator", "employed", "unemployed", "military",
    "weeks_worked", "black", "hispanic", "pov_status", "income_current_y_nas",
    "income_past_year_nas",
)


def q(name: str) -> str:
    return f'"{name}"'


def cohort_cte(baselines: str = "(4), (8), (12), (16)") -> str:
    """One join per wave looked at, as the cohorts are defined."""
    covars = ", ".join(f"s.{q(c)}" for c in COVARIATES)
    complete = " AND ".join(f"s.{q(c)} IS NOT NULL" for c in COVARIATES)
    return f""", cohort AS (
  SELECT b.bl, s.caseid, greatest(h1.ever_inc, h2.ever_inc, h3.ever_inc) AS treatment,
         y.log_wages, s.wages_nas AS wages_t0, {covars}
  FROM (VALUES {baselines}) AS b(bl)
  JOIN sample2 s ON s.wave = b.bl
  JOIN inca h1 ON h1.c = s.caseid AND h1.k = b.bl + 1
  JOIN inca h2 ON h2.c = s.caseid AND h2.k = b.bl + 2
  JOIN inca h3 ON h3.c = s.caseid AND h3.k = b.bl + 3
  JOIN sample2 y ON y.caseid = s.caseid AND y.wave = b.bl + 3
  WHERE s.incarcerated = 0 AND s.ever_inc = 0 AND y.incarcerated = 0 AND y.log_wages IS NOT NULL
    AND {complete})
"""


WITH_SAMPLE_ONE = PANEL + SAMPLE_ONE
WITH_SAMPLE_TWO = PANEL + SAMPLE_TWO
WITH_COHORT = WITH_SAMPLE_TWO + cohort_cte()

REALS_ONE = ("log_age", "log_weeks", "cog_ability", "wages_deflated", "log_wages")
REALS_TWO = (
    "log_age", "log_weeks", "cog_ability", "wages_deflated", "income_current_y_d",
    "income_past_year_d", "log_wages", "log_income_current_y", "log_income_past_y",
    "wages_nas", "income_current_y_nas", "income_past_year_nas",
)
REALS_COHORT = ("log_wages", "wages_t0", "cog_ability", "income_current_y_nas", "income_past_year_nas")


def replaced(names, source: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({n}, 6) AS {n}' for n in names)}) FROM {source}"


def cast_cohort(source: str = "cohort") -> str:
    ints_ = [c for c in COVARIATES if c not in REALS_COHORT and c not in ("total_weeks_worked", "weeks_worked")]
    casts = ", ".join(f"CAST({q(c)} AS INTEGER) AS {q(c)}" for c in ["bl", "treatment", *ints_])
    reals = ", ".join(f"round({c}, 6) AS {c}" for c in REALS_COHORT)
    return f"SELECT {casts}, {reals}, caseid, total_weeks_worked, weeks_worked FROM {source}"


# --- the yearly orders panel and the daily events panel ------------------------------------

ORDERS = """WITH RECURSIVE cell AS (
  SELECT o_custkey AS caseid, year(o_orderdate) - 1995 AS wave,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) / 100 AS wages,
         count(*) AS n_jobs,
         max(CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS inc
  FROM orders GROUP BY 1, 2),
op AS (
  SELECT g.caseid, CAST(g.wave AS INTEGER) AS wave, wages, n_jobs, CAST(coalesce(inc, 0) AS INTEGER) AS incarcerated
  FROM (SELECT c_custkey AS caseid, unnest(range(0, 7)) AS wave FROM customer) g
  LEFT JOIN cell USING (caseid, wave)),
oh AS (
  SELECT *, CAST(CASE WHEN incarcerated = 1 THEN 0
                 ELSE max(incarcerated) OVER (PARTITION BY caseid ORDER BY wave) END AS INTEGER) AS ever_inc
  FROM op)
"""
ORDERS_COHORT = ORDERS + """, oc AS (
  SELECT s.wave AS bl, s.caseid, greatest(h1.ever_inc, h2.ever_inc, h3.ever_inc) AS treatment,
         h3.wages, s.wages AS wages_t0, s.n_jobs
  FROM oh s JOIN oh h1 ON h1.caseid = s.caseid AND h1.wave = s.wave + 1
  JOIN oh h2 ON h2.caseid = s.caseid AND h2.wave = s.wave + 2
  JOIN oh h3 ON h3.caseid = s.caseid AND h3.wave = s.wave + 3
  WHERE s.wave IN (0, 1, 2, 3) AND s.incarcerated = 0 AND s.ever_inc = 0 AND h3.incarcerated = 0
    AND h3.wages IS NOT NULL AND s.wages IS NOT NULL AND s.n_jobs IS NOT NULL)
"""
SCORES = ORDERS_COHORT + """, cells AS (
  SELECT bl, n_jobs, avg(treatment) AS e,
         avg(CASE WHEN treatment = 1 THEN wages END) AS mu1, avg(CASE WHEN treatment = 0 THEN wages END) AS mu0,
         stddev_samp(CASE WHEN treatment = 1 THEN wages END) AS sd1,
         stddev_samp(CASE WHEN treatment = 0 THEN wages END) AS sd0
  FROM oc GROUP BY ALL),
sc_all AS (SELECT * FROM oc JOIN cells USING (bl, n_jobs)),
sc AS (SELECT * FROM sc_all WHERE e > 0 AND e < 1)
"""
EVENTS = """WITH ep AS (
  SELECT user_id AS caseid, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS wave,
         count(*) AS weeks_worked,
         max(CASE WHEN event_type = 'error' THEN 1 END) AS incarcerated,
         CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) END) AS BIGINT) / 100 AS welfare,
         max(CASE WHEN event_type = 'signup' THEN CAST(round(value * 100) AS BIGINT) END) AS drugs
  FROM events GROUP BY 1, 2)
"""


def sig(value: str, name: str, digits: int = 6) -> str:
    return f"CAST(printf('%.{digits}e', {value}) AS DOUBLE) AS {name}"


# --- least squares by the sweep operator -----------------------------------------------------


def sweep(
    frame: str, terms: dict[str, str], y: str, group: str | None = None, tag: str = ""
) -> str:
    """CTEs ending in ``fit<tag>``: the swept cross-products of ``terms`` and ``y``.

    ``frame`` is a relation. Rows with a null in any used column are left out; with
    ``group`` the columns are taken as deviations from group means.
    """
    cols = [*terms.values(), y]
    p = len(terms)
    names = [f"x{i}" for i in range(p + 1)]
    casts = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for e, n in zip(cols, names))
    complete = " AND ".join(f"{n} IS NOT NULL" for n in names)
    base = "avg({n}) OVER (PARTITION BY g)" if group else "avg({n}) OVER ()"
    centred = ", ".join(f"{n} - {base.format(n=n)} AS d{i}" for i, n in enumerate(names))
    total = ", ".join(f"var_pop({n}) * count(*) AS b{i}, avg({n}) AS m{i}" for i, n in enumerate(names))
    upper = ", ".join(
        f"sum(d{i} * d{j}) AS s{i}_{j}" for i in range(p + 1) for j in range(i, p + 1)
    )
    matrix = ", ".join(
        "[" + ", ".join(f"s{min(i, j)}_{max(i, j)}" for j in range(p + 1)) + "]" for i in range(p + 1)
    )
    return f""", fr{tag} AS (
  SELECT * FROM (SELECT {group or 0} AS g, {casts} FROM {frame}) WHERE {complete}),
dev{tag} AS (SELECT {centred} FROM fr{tag}),
tot{tag} AS (SELECT {total}, count(*) AS n, count(DISTINCT g) AS n_groups FROM fr{tag}),
cross0{tag} AS (SELECT {upper} FROM dev{tag}),
sw{tag} AS (
  SELECT 0 AS k, [{matrix}] AS m, CAST([] AS INTEGER[]) AS kept,
         [{', '.join(f'b{i}' for i in range(p + 1))}] AS base FROM cross0{tag}, tot{tag}
  UNION ALL
  SELECT k + 1,
    CASE WHEN base[k + 1] <= 0 OR m[k + 1][k + 1] <= 1e-10 * base[k + 1] THEN m ELSE
      list_transform(range(1, {p + 2}), lambda i: list_transform(range(1, {p + 2}), lambda j:
        CASE WHEN i = k + 1 AND j = k + 1 THEN -1 / m[k + 1][k + 1]
             WHEN i = k + 1 OR j = k + 1 THEN m[i][j] / m[k + 1][k + 1]
             ELSE m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] END)) END,
    CASE WHEN base[k + 1] <= 0 OR m[k + 1][k + 1] <= 1e-10 * base[k + 1] THEN kept
         ELSE list_append(kept, k + 1) END,
    base
  FROM sw{tag} WHERE k < {p}),
fit{tag} AS (
  SELECT m, kept, tot{tag}.*, m[{p + 1}][{p + 1}] AS rss,
         n - len(kept) - {'n_groups' if group else '1'} AS df,
         m[{p + 1}][{p + 1}] / (n - len(kept) - {'n_groups' if group else '1'}) AS variance,
         [{', '.join(f'm{i}' for i in range(p + 1))}] AS centre, b{p} AS total
  FROM sw{tag}, tot{tag} WHERE k = {p})
"""


def coefficient_rows(terms: dict[str, str], intercept: bool = True) -> str:
    """One relation with pos, term, estimate and se from ``fit``."""
    p = len(terms)
    parts = []
    if intercept:
        slope = " + ".join(
            f"CASE WHEN list_contains(kept, {j}) THEN m[{j}][{p + 1}] * centre[{j}] ELSE 0 END"
            for j in range(1, p + 1)
        )
        spread = (
            "list_sum(list_transform(kept, lambda i: list_sum(list_transform(kept, lambda j:"
            " -m[i][j] * centre[i] * centre[j]))))"
        )
        parts.append(
            f"SELECT 0 AS pos, '(intercept)' AS term, centre[{p + 1}] - ({slope}) AS estimate,"
            f" sqrt(variance * (1.0 / n + {spread})) AS se FROM fit"
        )
    for j, term in enumerate(terms, start=1):
        pos = j if intercept else j - 1
        parts.append(
            f"SELECT {pos}, '{term}', CASE WHEN list_contains(kept, {j}) THEN m[{j}][{p + 1}] END,"
            f" CASE WHEN list_contains(kept, {j}) THEN sqrt(-variance * m[{j}][{j}]) END FROM fit"
        )
    names = "" if intercept else " AS t(pos, term, estimate, se)"
    return f"({' UNION ALL '.join(parts)}){names}"


def coefficient_query(head: str, frame: str, terms: dict[str, str], y: str, group: str | None = None, digits: int = 6) -> str:
    rows = coefficient_rows(terms, group is None)
    return (
        head + sweep(frame, terms, y, group)
        + f"SELECT CAST(pos AS INTEGER) AS pos, term, {sig('estimate', 'estimate', digits)}, {sig('se', 'se', digits)} FROM {rows}"
    )


def plain(*names: str) -> dict[str, str]:
    return {n: q(n) for n in names}


def dummies(col: str, levels) -> dict[str, str]:
    return {
        f"{col}_{v}": f"CASE WHEN {col} IS NULL THEN NULL WHEN {col} = {v} THEN 1 ELSE 0 END"
        for v in levels
    }


WAGE = (
    "incarcerated", "ever_inc", "married", "log_age", "edyears", "lag_weeks_worked",
    "enrolled", "urban", "drugs", "union", "psector",
)
REPORTED = (*WAGE, "cog_ability", "charged80", "incarcerated80", "black", "hispanic")
SHARED = (
    "union", "psector", "married", "edyears", "enrolled", "drugs", "age", "cog_ability",
    "stopped80", "charged80", "probation80", "convicted80", "total_weeks_worked",
    "welfare_indicator", "employed", "unemployed", "military", "weeks_worked", "black",
    "hispanic", "pov_status",
)
NAIVE = ("ever_inc", "incarcerated", *SHARED, "urban", "income_current_y", "income_past_year", "year")
COHORT = ("treatment", *SHARED, "urban_nas", "income_current_y_nas", "income_past_year_nas", "wages_t0")
REGION_DUMMIES = dummies("region", (2, 3, 4))
INDUSTRY_DUMMIES = dummies("industry", (2, 3, 4, 5, 6))

COHORT_TERMS = {**plain(*COHORT), **REGION_DUMMIES}
WITHIN_TERMS = {**plain(*WAGE, "year"), **REGION_DUMMIES, **INDUSTRY_DUMMIES}
COHORT_FIT = WITH_COHORT + sweep("cohort", COHORT_TERMS, "log_wages")
WITHIN_FIT = WITH_SAMPLE_ONE + sweep("sample1", WITHIN_TERMS, "log_wages", "caseid")

N_DROPPED = "(SELECT count(*) FROM sc_all WHERE NOT (e > 0 AND e < 1)) AS n_dropped"
EFFECT_SELECT = ", ".join(
    ["CAST(n_rows AS BIGINT) AS n_rows", "CAST(n_persons AS BIGINT) AS n_persons", N_DROPPED, sig("est", "estimate"), sig("sd", "sd"),
     sig("est - 1.96 * sd", "ci_lower"), sig("est + 1.96 * sd", "ci_upper")]
)


def influence(value: str, weight: str) -> str:
    """Ratio estimate with person-clustered error, in two explicit passes."""
    return SCORES + f""", v AS (SELECT caseid, {value} AS val, {weight} AS wt FROM sc),
est AS (SELECT sum(val) / sum(wt) AS est, sum(wt) AS total, count(CASE WHEN wt <> 0 THEN 1 END) AS n_rows,
               count(DISTINCT CASE WHEN wt <> 0 THEN caseid END) AS n_persons FROM v),
per AS (SELECT caseid, sum(val - wt * est) AS psi FROM v, est GROUP BY caseid),
res AS (SELECT any_value(est) AS est, sqrt(sum(psi * psi)) / any_value(total) AS sd,
               any_value(n_rows) AS n_rows, any_value(n_persons) AS n_persons FROM per, est)
SELECT {EFFECT_SELECT} FROM res"""


def sensitivity(head: str) -> str:
    strengths = ", ".join(f"({s}::DOUBLE)" for s in (0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5))
    p = len(COHORT_TERMS)
    return head + f""", one AS (SELECT m[1][{p + 1}] AS est, sqrt(-variance * m[1][1]) AS se, CAST(df AS DOUBLE) AS df FROM fit),
strengths AS (SELECT d.s AS r2_treatment, y.s AS r2_outcome FROM (VALUES {strengths}) AS d(s), (VALUES {strengths}) AS y(s)),
adj AS (SELECT r2_treatment, r2_outcome, se * sqrt(df) * sqrt(r2_outcome * r2_treatment / (1 - r2_treatment)) AS bias,
               se * sqrt((1 - r2_outcome) / (1 - r2_treatment)) * sqrt(df / (df - 1)) AS adjusted_se, est FROM strengths, one),
fin AS (SELECT *, CASE WHEN est < 0 THEN est + bias ELSE est - bias END AS adjusted_estimate FROM adj)
SELECT r2_treatment, r2_outcome, {sig('bias', 'bias', 5)}, {sig('adjusted_estimate', 'adjusted_estimate', 5)},
       {sig('adjusted_se', 'adjusted_se', 5)}, {sig('adjusted_estimate / adjusted_se', 'adjusted_t', 5)} FROM fin"""


WITHIN_SCORED = ORDERS + """, wr AS (SELECT caseid, wave, wages, CAST(n_jobs AS DOUBLE) AS n_jobs FROM op WHERE wages IS NOT NULL AND n_jobs IS NOT NULL),
dm AS (SELECT *, avg(wages) OVER (PARTITION BY caseid) AS yb, avg(n_jobs) OVER (PARTITION BY caseid) AS xb FROM wr),
sl AS (SELECT sum((n_jobs - xb) * (wages - yb)) / sum((n_jobs - xb) * (n_jobs - xb)) AS slope FROM dm),
scored AS (SELECT caseid, wave, yb + slope * (n_jobs - xb) AS fitted, wages - yb - slope * (n_jobs - xb) AS residual FROM dm, sl)
"""


def binned(head: str, x: str, y: str, source: str, low: float, high: float, bins: int) -> str:
    width = (high - low) / bins
    return head + f""", bx AS (SELECT {x} AS x, {y} AS v FROM {source})
SELECT CAST(CASE WHEN x IS NULL THEN NULL WHEN x < {low} THEN 0 WHEN x >= {high} THEN {bins + 1} ELSE floor((x - ({low})) / {width}) + 1 END AS INTEGER) AS bin,
       count(*) AS n, round(avg(v), 3) AS mean, round(stddev_samp(v), 3) AS sd, round(min(v), 3) AS low, round(max(v), 3) AS high
FROM bx GROUP BY 1"""


def quantile_rows(head: str, value: str, source: str, shares, parts: dict[str, str], digits: int | None) -> str:
    rows = []
    for part, cond in parts.items():
        for share in shares:
            found = f"quantile_cont({value}, {share})"
            found = found if digits is None else f"round({found}, {digits})"
            rows.append(
                f"SELECT '{part}' AS part, {share}::DOUBLE AS share, {found} AS value FROM {source} WHERE {cond}"
            )
    return head + " UNION ALL ".join(rows)


def wide_pivot(name: str, expr: str, waves=range(27)) -> str:
    return ", ".join(
        f"CAST(max(CASE WHEN k = {k} THEN {expr} END) AS DOUBLE) AS {name if i == 0 else f'{name}_{i}'}"
        for i, k in enumerate(waves)
    )


INCOME_RAW = (
    "CASE WHEN away OR (c + k) % 29 = 0 THEN NULL WHEN n > 0 AND (c + k) % 31 = 0 THEN -9 WHEN n > 0 THEN floor(cents / 1000) END"
)
WAGE_RAW = "CASE WHEN n > 0 THEN floor(cents / 10000) WHEN away THEN -5 ELSE -4 END"
REGION_RAW = "CASE WHEN away THEN -5 ELSE 1 + nk % 4 END"
WORKER_RAW = "CASE WHEN away THEN -5 ELSE 1 + (nk + k) % 3 END"


def names_of(stem: str, count: int) -> list[str]:
    return [stem if i == 0 else f"{stem}_{i}" for i in range(count)]


def select_and_drop() -> str:
    gone = {f"hrp1_{i}" for i in range(27) if i == 2 or 20 <= i <= 26}
    gone |= {f"region_{i}" for i in range(27) if i == 1 or 10 <= i <= 19 or i == 2 or 20 <= i <= 26} | {"region"}
    wages = [(n, k) for k, n in enumerate(names_of("hrp1", 27)) if n not in gone]
    regions = [(n, k) for k, n in enumerate(names_of("region", 27)) if n not in gone]
    cols = [f"CAST(max(CASE WHEN k = {k} THEN {WAGE_RAW} END) AS DOUBLE) AS {n}" for n, k in wages]
    cols += [f"CAST(max(CASE WHEN k = {k} THEN {REGION_RAW} END) AS DOUBLE) AS {n}" for n, k in regions]
    cols += [
        "CAST(any_value(nk) % 3 + 1 AS DOUBLE) AS sample_race",
        "CAST(c % 2 + 1 AS DOUBLE) AS sample_sex",
    ]
    return "WITH " + CELL.strip().rstrip(",") + f" SELECT c AS caseid, {', '.join(cols)} FROM cell GROUP BY c"


def wide_query(columns: str) -> str:
    return "WITH " + CELL.strip().rstrip(",") + f" SELECT c AS caseid, {columns} FROM cell GROUP BY c"


ORDERS_TERMS = {"treatment": "treatment"}
RANDOM_SMALL = ORDERS_COHORT + sweep("oc", ORDERS_TERMS, "wages") + sql_fits.random_intercept("oc", ORDERS_TERMS, "wages", "caseid")
RANDOM_COHORT = COHORT_FIT + sql_fits.random_intercept("cohort", COHORT_TERMS, "log_wages", "caseid")


def random_rows(head: str, terms: dict[str, str]) -> str:
    rows = sql_fits.random_intercept_rows(terms)
    return head + (
        f"SELECT CAST(pos AS INTEGER) AS pos, term, {sig('estimate', 'estimate')}, {sig('se', 'se')} FROM {rows}"
    )


def random_fit(head: str) -> str:
    return head + (
        "SELECT CAST(n_rows AS BIGINT) AS n, CAST(n_rows - len(use) AS BIGINT) AS df, (SELECT count(*) FROM gv) AS n_groups, "
        f"{sig('sqrt(variance)', 'sigma')}, {sig('sqrt(th * variance)', 'group_sd')} FROM best"
    )


EFFECT_TERMS = {**plain(*COHORT[1:], "bl"), **REGION_DUMMIES}
CROSS_FITTED = WITH_COHORT + sql_fits.cross_fitted("cohort", EFFECT_TERMS, "log_wages", "treatment")
ROW_KEYS = "caseid, CAST(bl AS INTEGER) AS bl, CAST(treatment AS INTEGER) AS treatment"
INTERVAL = ", ".join(
    [sig("est", "estimate"), sig("sd", "sd"), sig("est - 1.96 * sd", "ci_lower"), sig("est + 1.96 * sd", "ci_upper")]
)


def cross_fitted_estimate(value: str, weight: str) -> str:
    return CROSS_FITTED + sql_fits.ratio_average(value, weight) + (
        "SELECT CAST(n_rows AS BIGINT) AS n_rows, CAST(n_persons AS BIGINT) AS n_persons, CAST(n_clipped AS BIGINT) AS n_clipped, "
        f"{INTERVAL} FROM res"
    )


def survey_codes() -> str:
    """The raw survey, missing codes and all, pivoted from the long cells."""
    age = "CASE WHEN away THEN -5 ELSE 16 + yr - 1979 + c % 8 END"
    home = "CASE WHEN inc = 1 THEN 5 WHEN away THEN -5 WHEN n > 0 THEN 1 + c % 4 ELSE -4 END"
    income = (
        "CASE WHEN away THEN -5 WHEN (c + k) % 29 = 0 THEN -1 WHEN n > 0 AND (c + k) % 31 = 0 THEN -9"
        " WHEN n > 0 THEN floor(cents / 1000) ELSE -4 END"
    )
    esr = f"coalesce({ESR}, -5)"
    industry = "CASE WHEN n = 0 THEN -4 ELSE ind END"
    welfare = (
        "CASE WHEN away THEN -5 WHEN n > 0 THEN 0 WHEN (c + k) % 97 = 0 THEN amt * 50"
        " WHEN (c + k) % 3 = 0 THEN amt ELSE -4 END"
    )
    years = [1979 + k if k < 16 else 2 * (k + 982) for k in range(27)]

    def by_year(expr: str, name) -> str:
        return ", ".join(
            f"CAST(max(CASE WHEN k = {k} THEN {expr} END) AS DOUBLE) AS {name(y)}"
            for k, y in enumerate(years)
        )

    def item(name: str, count: int, blank: int, code: int, factor: int, every: int) -> list[str]:
        return [
            f"CAST(CASE WHEN (c + {j}) % {blank} = 0 THEN {code} WHEN (c * {factor} + {j}) % {every} = 0"
            f" THEN 1 ELSE 0 END AS DOUBLE) AS {name if j == 0 else f'{name}_{j}'}"
            for j in range(count)
        ]

    police = {
        "police_1": "CASE WHEN c % 9 = 0 THEN -4 ELSE (c // 2) % 2 END",
        "police_2": "CASE WHEN c % 3 = 0 THEN -4 ELSE (c // 4) % 2 END",
        "police_3": "CASE WHEN c % 4 = 0 THEN -4 WHEN c % 10 = 1 THEN 1 ELSE 0 END",
        "police_6": "CASE WHEN c % 5 = 0 THEN -2 WHEN (c // 3) % 4 = 0 THEN 1 ELSE 0 END",
        "police_7": "CASE WHEN c % 6 = 0 THEN -4 WHEN (c // 5) % 8 = 0 THEN 1 ELSE 0 END",
    }
    parts = [
        wide_pivot("ageatint", age),
        wide_pivot("hh1_1", home),
        wide_pivot("q13_5", income, range(3)),
        wide_pivot("q13_5_trunc_revised", income, range(3, 19)),
        wide_pivot("q13_5_trunc", income, range(19, 27)),
        wide_pivot("povstatus", "CASE WHEN away THEN -5 WHEN (c + k) % 13 = 0 THEN -3 ELSE (nk + k) % 2 END"),
        wide_pivot("urban_rural", "CASE WHEN away THEN -5 WHEN (c + k) % 17 = 0 THEN -4 ELSE (c + k // 4) % 2 END"),
        wide_pivot("hgc", f"coalesce({EDYEARS}, -5)"),
        wide_pivot("wkswk_pcy", "CASE WHEN away THEN -5 ELSE n * 9 END"),
        wide_pivot("marstat_key", "CASE WHEN away THEN -5 ELSE 1 + (c + k // 6) % 3 END"),
        wide_pivot("esr_key", esr, [*range(18), 21]),
        wide_pivot("cps_qes_56c", WORKER_RAW, range(15)),
        wide_pivot("qes_56c_01", WORKER_RAW, range(15, 27)),
        wide_pivot("region", REGION_RAW),
        wide_pivot("cpsind70", industry, range(15)),
        *[wide_pivot(f"indall_emp_01_{k}", industry, [k]) for k in range(10, 27)],
        wide_pivot("hrp1", WAGE_RAW),
        by_year("CASE WHEN away THEN -5 ELSE 1 + (c * 3 + k) % 4 END", lambda y: f"enrollmtrev{y % 100:02d}"),
        by_year("CASE WHEN n = 0 THEN -4 WHEN n > 1 THEN 1 ELSE 0 END", lambda y: f"employers_all_union_{y}_01"),
        by_year("CASE WHEN away THEN -4 WHEN (nk + k) % 3 = 0 THEN 1 ELSE 0 END", lambda y: f"employers_all_union_{y}_02"),
        by_year(welfare, lambda y: f"welfare_amt_{y}_tot"),
        *item("ds_11", 5, 6, -4, 1, 11),
        *item("ds_15", 5, 5, -2, 3, 13),
        *item("ds_19", 3, 7, -4, 1, 4),
        "CAST(CASE WHEN c % 23 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS drug_1",
        "CAST(any_value(nk) % 3 + 1 AS DOUBLE) AS sample_race",
        "CAST(c % 2 + 1 AS DOUBLE) AS sample_sex",
        "CAST(CASE WHEN any_value(bal) < 0 THEN -4 ELSE floor(any_value(bal) / 10) END AS DOUBLE) AS afqt_1",
        *[f"CAST({e} AS DOUBLE) AS {n}" for n, e in police.items()],
    ]
    return wide_query(", ".join(parts))


ORACLES: dict[str, str] = {
    "survey_wide": survey_codes(),
    "read_wide_csv": "SELECT caseid, CAST(COLUMNS(* EXCLUDE (caseid)) AS DOUBLE) FROM (" + survey_codes() + ")",
    "select_and_drop": select_and_drop(),
    "select_by_substring": wide_query(
        ", ".join([
            wide_pivot("cps_qes_56c", WORKER_RAW, range(15)),
            wide_pivot("qes_56c_01", WORKER_RAW, range(15, 27)),
        ])
    ),
    "sentinel_null": "WITH coded AS MATERIALIZED (" + survey_codes() + ") SELECT caseid,"
        " CASE WHEN COLUMNS('^[^c]|^cps') BETWEEN -5 AND -1 THEN NULL ELSE COLUMNS('^[^c]|^cps') END AS '\\0' FROM coded",
    "melt_keep_nulls": from_cells(
        f"c AS caseid, CASE WHEN k = 0 THEN 'AGEATINT' ELSE 'AGEATINT.' || k END AS variable, CAST({AGE} AS DOUBLE) AS age"
    ),
    "name_to_wave": from_cells(
        "stem, CAST(k AS INTEGER) AS wave, count(CASE WHEN NOT away THEN 1 END) AS n_answers, count(*) AS n_rows",
        source="cell, (VALUES ('WKSW'), ('MARSTA')) AS s(stem)",
    ) + " GROUP BY 1, 2",
    "spread_two_stems": from_cells(f"{KEYS}, {ints(edyears=EDYEARS, enrolled=ENROLLED)}"),
    "wave_shift": from_cells(
        f"CASE WHEN k < 3 THEN 'Q1' WHEN k < 19 THEN 'Q1_TRUNC_REVISED' ELSE 'Q1_TRUNC' END AS stem,"
        f" CAST(k AS INTEGER) AS wave, count({INCOME_RAW}) AS n_answers, CAST(sum({INCOME_RAW}) AS BIGINT) AS total"
    ) + " GROUP BY 1, 2",
    "wave_lookup": "WITH " + DRUG_ITEMS + """ SELECT stem, CAST(k AS INTEGER) AS wave, CAST(kf AS INTEGER) AS wave_fixed,
        count(v) AS n_answers, CAST(sum(v) AS BIGINT) AS total FROM placed GROUP BY 1, 2, 3""",
    "year_to_wave": from_cells("c AS caseid, CAST(yr AS INTEGER) AS year, CAST(k AS INTEGER) AS wave"),
    "fill_if_observed": """
        SELECT c_custkey AS caseid, CAST(s1 AS DOUBLE) AS police_1,
               CAST(CASE WHEN s2 IS NULL AND s1 IS NOT NULL THEN 0 ELSE s2 END AS DOUBLE) AS police_2,
               CAST(CASE WHEN s3 IS NULL AND s1 IS NOT NULL THEN 0 ELSE s3 END AS DOUBLE) AS police_3,
               CAST(CASE WHEN s6 IS NULL AND s1 IS NOT NULL THEN 0 ELSE s6 END AS DOUBLE) AS police_6,
               CAST(CASE WHEN s7 IS NULL AND s1 IS NOT NULL THEN 0 ELSE s7 END AS DOUBLE) AS police_7
        FROM (SELECT c_custkey,
               CASE WHEN c_custkey % 9 <> 0 THEN (c_custkey // 2) % 2 END AS s1,
               CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey // 4) % 2 END AS s2,
               CASE WHEN c_custkey % 4 <> 0 THEN CASE WHEN c_custkey % 10 = 1 THEN 1 ELSE 0 END END AS s3,
               CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN (c_custkey // 3) % 4 = 0 THEN 1 ELSE 0 END END AS s6,
               CASE WHEN c_custkey % 6 <> 0 THEN CASE WHEN (c_custkey // 5) % 8 = 0 THEN 1 ELSE 0 END END AS s7
              FROM customer)""",
    "three_valued_flags": """
        SELECT caseid, CAST(CASE WHEN code IS NOT NULL THEN CASE WHEN code = 2 THEN 1 ELSE 0 END END AS INTEGER) AS is_two,
               CAST(CASE WHEN code IS NOT NULL THEN CASE WHEN code >= 2 THEN 1 ELSE 0 END END AS INTEGER) AS is_two_or_three,
               CAST(CASE WHEN code IS NOT NULL THEN CASE WHEN code > 0 THEN 1 ELSE 0 END END AS INTEGER) AS is_positive,
               CAST(CASE WHEN code IS NOT NULL THEN CASE WHEN code < 1 THEN 0 ELSE 1 END END AS INTEGER) AS at_least_one,
               CAST(coalesce(code, -10) AS INTEGER) AS coded
        FROM (SELECT c_custkey AS caseid, CASE WHEN c_acctbal >= 0 THEN c_nationkey % 4 END AS code FROM customer)""",
    "bin_ranges": """
        SELECT code, CAST(CASE WHEN code IS NULL THEN NULL WHEN code BETWEEN 67 AND 398 THEN 1 WHEN code <= 57 THEN 2
                 WHEN code BETWEEN 407 AND 479 THEN 3 WHEN code BETWEEN 507 AND 698 THEN 4
                 WHEN code BETWEEN 707 AND 898 THEN 5 ELSE 6 END AS INTEGER) AS industry, count(*) AS n
        FROM (SELECT CASE WHEN l_linenumber < 7 THEN (l_partkey * 7 + l_suppkey) % 950 END AS code FROM lineitem)
        GROUP BY 1, 2""",
    "any_positive_by_year": """
        SELECT o_custkey AS caseid, CAST(year(o_orderdate) AS INTEGER) AS year,
               CAST(max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS INTEGER) AS flag
        FROM orders GROUP BY 1, 2""",
    "any_positive_by_wave": """
        SELECT l_suppkey AS caseid, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) // 30 AS BIGINT) AS wave,
               CAST(max(CASE WHEN l_returnflag = 'R' AND l_quantity > 0 THEN 1 ELSE 0 END) AS INTEGER) AS flag
        FROM lineitem GROUP BY 1, 2""",
    "topic_non_interview": from_cells(f"{KEYS}, {ints(non_interview='CASE WHEN away THEN 1 ELSE 0 END')}"),
    "topic_age": from_cells(f"{KEYS}, {ints(age=AGE)}"),
    "topic_incarceration": from_cells(
        f"{KEYS}, {ints(incarcerated='incarcerated', ever_inc='ever_inc')}", INCARCERATION, "inca"
    ),
    "topic_income": from_cells(
        f"{KEYS}, {doubles(income_past_year='income', income_current_y='income_next')}", INCOME, "inco"
    ),
    "topic_poverty": from_cells(f"{KEYS}, {ints(pov_status=POVERTY)}"),
    "topic_urban": from_cells(f"{KEYS}, {ints(urban=URBAN)}"),
    "topic_education": from_cells(f"{KEYS}, {ints(edyears=EDYEARS, enrolled=ENROLLED)}"),
    "topic_work": from_cells(
        f"{KEYS}, {doubles(weeks_worked='w', total_weeks_worked='total', lag_weeks_worked='lag_total')}", WORK, "wrk"
    ),
    "topic_marriage": from_cells(f"{KEYS}, {ints(married=MARRIED)}"),
    "topic_union": from_cells(f'{KEYS}, CAST(yr AS INTEGER) AS year, CAST({UNION} AS INTEGER) AS "union"'),
    "topic_static": "WITH " + STATIC + f" SELECT CAST(c AS BIGINT) AS caseid, {STATIC_SELECT} FROM sta",
    "topic_employment": from_cells(
        f"{KEYS}, {ints(employed=EMPLOYED, unemployed=UNEMPLOYED, military=MILITARY)}", where=ESR_WAVES
    ),
    "topic_psector": from_cells(f"{KEYS}, {ints(psector=PSECTOR)}"),
    "topic_region": from_cells(f"{KEYS}, {ints(region=REGION)}"),
    "topic_industry": from_cells(f"{KEYS}, {ints(industry=INDUSTRY)}"),
    "topic_drugs": "WITH " + DRUG_ITEMS + f" SELECT {KEYS}, {ints(drugs='drugs')} FROM drg",
    "topic_drugs_fixed": "WITH " + DRUG_ITEMS + f" SELECT {KEYS}, {ints(drugs='drugs')} FROM drgf",
    "topic_wages": from_cells(f"{KEYS}, {doubles(wages='wages', wages_lead='wages_lead')}", WAGES, "wag"),
    "topic_welfare": from_cells(
        f"CAST(c AS BIGINT) AS caseid, CAST(yr AS INTEGER) AS year, {doubles(welfare='welfare')}, {ints(welfare_indicator='welfare_indicator')}",
        WELFARE, "wel",
    ),
    "panel_assembly": PANEL + "SELECT * FROM panel",
    "panel_join_chain": PANEL + "SELECT * FROM panel",
    "panel_drugs_fixed": from_cells(
        f"CAST(cell.c AS BIGINT) AS caseid, CAST(cell.k AS INTEGER) AS wave, {ints(drugs='drgf.drugs')}",
        DRUG_ITEMS, "cell LEFT JOIN drgf USING (c, k)",
    ),
    "lead_lag_running": EVENTS + """SELECT caseid, wave, weeks_worked, lead(weeks_worked) OVER w AS next_weeks,
        lag(weeks_worked) OVER w AS previous_weeks, CAST(sum(weeks_worked) OVER w AS BIGINT) AS total_weeks,
        CAST(sum(weeks_worked) OVER w - weeks_worked AS BIGINT) * CASE WHEN lag(weeks_worked) OVER w IS NULL THEN NULL ELSE 1 END AS lag_total_weeks
        FROM ep WINDOW w AS (PARTITION BY caseid ORDER BY wave)""",
    "ffill": EVENTS + "SELECT caseid, wave, " + FILLED + " AS drugs FROM ep",
    "backfill_from_wave": ORDERS + """SELECT o.caseid, o.wave, CASE WHEN o.wave = 0 AND o.n_jobs IS NULL THEN s.n_jobs ELSE o.n_jobs END AS n_jobs
        FROM op o LEFT JOIN op s ON s.caseid = o.caseid AND s.wave = 1""",
    "exposure_history": ORDERS + "SELECT caseid, wave, incarcerated, ever_inc FROM oh",
    "exposure_history_sparse": EVENTS + """SELECT e.caseid, e.wave, CAST(coalesce(e.incarcerated, 0) AS INTEGER) AS incarcerated,
        CAST(CASE WHEN e.incarcerated = 1 THEN 0 WHEN EXISTS (SELECT 1 FROM ep p WHERE p.caseid = e.caseid AND p.wave < e.wave AND p.incarcerated = 1) THEN 1 ELSE 0 END AS INTEGER) AS ever_inc
        FROM ep e""",
    "deflate_and_log": PANEL + "SELECT caseid, wave, round(wages / coalesce(idx, 1), 6) AS wages_real, round(income_past_year / idx, 6) AS income_real,"
        " round(ln(wages + 1), 6) AS log_wages, round(ln(age / 100), 6) AS log_age_share FROM panel LEFT JOIN " + INDEX + " ON w = wave",
    "rowwise_max": "SELECT caseid, greatest("
        + ", ".join(
            f"CASE WHEN {c} >= 0 THEN {c} END"
            for stem, n in (("ds_11", 5), ("ds_15", 5), ("ds_19", 3)) for c in (stem, *(f"{stem}_{j}" for j in range(1, n)))
        )
        + ") AS largest FROM (" + survey_codes() + ")",
    "cap_k_median": EVENTS + """, w AS (SELECT caseid, wave, coalesce(welfare, 0) AS welfare FROM ep)
        SELECT caseid, wave, CASE WHEN welfare <= 2 * (SELECT median(welfare) FROM w WHERE welfare >= 1) THEN welfare END AS welfare,
               CAST(CASE WHEN welfare < 1 THEN 0 ELSE 1 END AS INTEGER) AS welfare_indicator FROM w""",
    "filter_below_k_median": ORDERS + """SELECT caseid, wave, wages FROM op
        WHERE wages > 0 AND wages < 2 * (SELECT median(wages) FROM op)""",
    "global_medians": quantile_rows(
        "", "l_extendedprice", "lineitem", (0.25, 0.5, 0.9), {"all": "true", "returned": "l_returnflag = 'R'"}, None
    ),
    "exclude_ids": ORDERS + """SELECT caseid, wave, wages FROM op o
        WHERE NOT EXISTS (SELECT 1 FROM op x WHERE x.caseid = o.caseid AND x.incarcerated = 1)""",
    "attach_wave": ORDERS + """SELECT a.caseid, a.wages AS wages_t0, b.wages AS wages_t1, b.n_jobs AS jobs_t1, d.wages AS wages_t3
        FROM op a LEFT JOIN op b ON b.caseid = a.caseid AND b.wave = 3 LEFT JOIN op d ON d.caseid = a.caseid AND d.wave = 5
        WHERE a.wave = 2""",
    "null_safe_join": """WITH p AS (SELECT c_custkey, c_nationkey, CASE WHEN n_regionkey < 4 THEN n_regionkey END AS region
          FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey)
        SELECT *, count(*) OVER (PARTITION BY region) AS n_region FROM p""",
    "stack_missing_columns": """SELECT s_suppkey AS id, s_nationkey AS nation, 'supplier' AS kind, CAST(NULL AS VARCHAR) AS segment FROM supplier
        UNION ALL SELECT c_custkey, NULL, 'customer', c_mktsegment FROM customer""",
    "sample_one": WITH_SAMPLE_ONE + replaced(REALS_ONE, "sample1"),
    "sample_two": WITH_SAMPLE_TWO + replaced(REALS_TWO, "sample2"),
    "cohort_one": WITH_SAMPLE_TWO + cohort_cte("(8)") + cast_cohort(),
    "cohort_all": WITH_COHORT + cast_cohort(),
    "orders_cohorts": ORDERS_COHORT + "SELECT * FROM oc",
    "treatment_identity": ORDERS_COHORT + "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_bad FROM oc",
    "diff_in_means": ORDERS_COHORT + """, d AS (SELECT count(CASE WHEN treatment = 1 THEN 1 END) AS n_treated, count(CASE WHEN treatment = 0 THEN 1 END) AS n_control,
          avg(CASE WHEN treatment = 1 THEN wages END) AS mt, avg(CASE WHEN treatment = 0 THEN wages END) AS mc FROM oc)
        SELECT n_treated, n_control, round(mt, 4) AS mean_treated, round(mc, 4) AS mean_control, round(mt - mc, 4) AS difference FROM d""",
    "design_matrix": WITH_COHORT + "SELECT caseid, CAST(bl AS INTEGER) AS bl, "
        + ", ".join(
            f"round(CAST({q(c)} AS DOUBLE), 6) AS {q(c)}" for c in ("log_wages", *COHORT)
        )
        + ", " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in REGION_DUMMIES.items()) + " FROM cohort",
    "design_levels": """WITH p AS (SELECT c_custkey, c_nationkey % 5 AS nation, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bal,
            CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END AS segment FROM customer)
        SELECT c_custkey, bal, """
        + ", ".join(f"CAST(CASE WHEN nation = {v} THEN 1 ELSE 0 END AS DOUBLE) AS nation_{v}" for v in (1, 2, 3, 4)) + ", "
        + ", ".join(
            f"CAST(CASE WHEN segment = '{v}' THEN 1 ELSE 0 END AS DOUBLE) AS segment_{v.lower()}"
            for v in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
        )
        + " FROM p WHERE bal IS NOT NULL AND segment IS NOT NULL",
    "ols_1": ORDERS_COHORT + ", r AS (SELECT regr_slope(wages, treatment) AS b, regr_intercept(wages, treatment) AS a, regr_sxx(wages, treatment) AS sxx,"
        " regr_syy(wages, treatment) AS syy, regr_sxy(wages, treatment) AS sxy, count(*) AS n, avg(treatment) AS xb FROM oc),"
        " s AS (SELECT *, (syy - sxy * sxy / sxx) / (n - 2) AS v FROM r)"
        f" SELECT 0 AS pos, '(intercept)' AS term, {sig('a', 'estimate')}, {sig('sqrt(v * (1.0 / n + xb * xb / sxx))', 'se')} FROM s"
        f" UNION ALL SELECT 1, 'treatment', {sig('b', 'estimate')}, {sig('sqrt(v / sxx)', 'se')} FROM s",
    "ols_2": coefficient_query(ORDERS_COHORT, "oc", plain("treatment", "wages_t0"), "wages"),
    "wage_ols": coefficient_query(WITH_SAMPLE_ONE, "sample1", {**plain(*WAGE), **REGION_DUMMIES}, "log_wages"),
    "wage_ols_reported": coefficient_query(
        WITH_SAMPLE_ONE, "sample1", {**plain(*REPORTED), **REGION_DUMMIES, **INDUSTRY_DUMMIES}, "log_wages"
    ),
    "naive_ols": coefficient_query(WITH_SAMPLE_TWO, "sample2", {**plain(*NAIVE), **REGION_DUMMIES}, "log_wages"),
    "cohort_ols": coefficient_query(WITH_COHORT, "cohort", COHORT_TERMS, "log_wages"),
    "cohort_ols_fit": COHORT_FIT + f"SELECT n, CAST(len(kept) + 1 AS INTEGER) AS k, CAST(df AS BIGINT) AS df, {sig('sqrt(variance)', 'sigma')}, {sig('1 - rss / total', 'r2')} FROM fit",
    "collinear_ols": coefficient_query(
        WITH_COHORT, "cohort",
        {"treatment": "treatment", "wages_t0": "wages_t0", "age": "age", "mixed": "2 * age - wages_t0", "constant": "1"},
        "log_wages",
    ),
    "within_ols_1": ORDERS + """, wr AS (SELECT caseid, wages, CAST(n_jobs AS DOUBLE) AS x FROM op WHERE wages IS NOT NULL AND n_jobs IS NOT NULL),
        dm AS (SELECT wages - avg(wages) OVER (PARTITION BY caseid) AS y, x - avg(x) OVER (PARTITION BY caseid) AS x FROM wr),
        r AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy, count(*) AS n FROM dm)
        SELECT 0 AS pos, 'n_jobs' AS term, """ + sig("b", "estimate") + ", "
        + sig("sqrt((syy - sxy * sxy / sxx) / (n - 1 - (SELECT count(DISTINCT caseid) FROM wr)) / sxx)", "se") + " FROM r",
    "within_ols_full": coefficient_query(WITH_SAMPLE_ONE, "sample1", WITHIN_TERMS, "log_wages", "caseid"),
    "within_ols_fit": WITHIN_FIT + f"SELECT n, CAST(len(kept) AS INTEGER) AS k, CAST(df AS BIGINT) AS df, n_groups, {sig('sqrt(variance)', 'sigma')}, "
        + sig("1 - rss / (SELECT s%d_%d FROM cross0)" % (len(WITHIN_TERMS), len(WITHIN_TERMS)), "r2") + " FROM fit",
    "clustered_ols": ORDERS_COHORT + sweep("oc", plain("treatment", "n_jobs"), "wages") + """, lv AS (
        SELECT caseid, [1.0, treatment - centre[1], n_jobs - centre[2]] AS x,
               wages - centre[3] - m[1][3] * (treatment - centre[1]) - m[2][3] * (n_jobs - centre[2]) AS e FROM oc, fit),
        u AS (SELECT caseid, sum(x[1] * e) AS u1, sum(x[2] * e) AS u2, sum(x[3] * e) AS u3 FROM lv GROUP BY caseid),
        meat AS (SELECT [[sum(u1 * u1), sum(u1 * u2), sum(u1 * u3)], [sum(u1 * u2), sum(u2 * u2), sum(u2 * u3)],
                         [sum(u1 * u3), sum(u2 * u3), sum(u3 * u3)]] AS q, count(*) AS g FROM u),
        rowsof AS (
            SELECT 0 AS pos, '(intercept)' AS term, centre[3] - m[1][3] * centre[1] - m[2][3] * centre[2] AS estimate,
                   [1.0 / n, m[1][1] * centre[1] + m[2][1] * centre[2], m[1][2] * centre[1] + m[2][2] * centre[2]] AS h FROM fit
            UNION ALL SELECT 1, 'treatment', m[1][3], [0, -m[1][1], -m[1][2]] FROM fit
            UNION ALL SELECT 2, 'n_jobs', m[2][3], [0, -m[2][1], -m[2][2]] FROM fit)
        SELECT CAST(pos AS INTEGER) AS pos, term, """ + sig("estimate", "estimate") + ", "
        + sig("sqrt(g / (g - 1) * (n - 1) / df * list_sum(list_transform(range(1, 4), lambda i: h[i] * list_sum(list_transform(range(1, 4), lambda j: h[j] * q[i][j])))))", "se")
        + " FROM rowsof, meat, (SELECT n, df FROM fit)",
    "random_intercept": random_rows(RANDOM_COHORT, COHORT_TERMS),
    "random_intercept_fit": random_fit(RANDOM_COHORT),
    "random_intercept_small": random_rows(RANDOM_SMALL, ORDERS_TERMS),
    "random_intercept_small_fit": random_fit(RANDOM_SMALL),
    "propensity": CROSS_FITTED + f"SELECT {ROW_KEYS}, fold, clipped, {sig('e', 'e')} FROM scored",
    "outcome_surface": CROSS_FITTED
        + f"SELECT {ROW_KEYS}, {', '.join(sig(c, c) for c in ('mu1', 'mu0', 'sd1', 'sd0'))} FROM scored",
    "support_trim": CROSS_FITTED + "SELECT CAST(treatment AS INTEGER) AS treatment, supported, count(*) AS n, "
        + sig("avg(CASE WHEN treatment = 1 THEN sd1 ELSE sd0 END)", "sd_factual") + ", "
        + sig("avg(CASE WHEN treatment = 1 THEN sd0 ELSE sd1 END)", "sd_counterfactual") + " FROM trimmed GROUP BY 1, 2",
    "ate_crossfit": cross_fitted_estimate(
        "mu1 - mu0 + treatment * (y - mu1) / e - (1 - treatment) * (y - mu0) / (1 - e)", "1"
    ),
    "att_crossfit": cross_fitted_estimate("treatment * (mu1 - mu0)", "treatment"),
    "att_crossfit_draws": CROSS_FITTED + sql_fits.bootstrap(poisson_cuts(), REPLICATES)
        + f"SELECT n_draws, {INTERVAL} FROM drawn",
    "fitted_residuals": COHORT_FIT + ", b AS (SELECT "
        + ", ".join(
            f"CASE WHEN list_contains(kept, {j}) THEN m[{j}][{len(COHORT_TERMS) + 1}] ELSE 0 END AS b{j}, centre[{j}] AS c{j}"
            for j in range(1, len(COHORT_TERMS) + 1)
        )
        + f", centre[{len(COHORT_TERMS) + 1}] AS yb FROM fit), f AS (SELECT caseid, bl, log_wages, yb + "
        + " + ".join(f"b{j} * (({e}) - c{j})" for j, e in enumerate(COHORT_TERMS.values(), start=1))
        + " AS fitted FROM cohort, b) SELECT caseid, CAST(bl AS INTEGER) AS bl, round(fitted, 5) AS fitted, round(log_wages - fitted, 5) AS residual FROM f",
    "within_residuals": WITHIN_SCORED + "SELECT caseid, wave, round(fitted, 4) AS fitted, round(residual, 4) AS residual FROM scored",
    "aipw_given_scores": influence(
        "mu1 - mu0 + treatment * (wages - mu1) / e - (1 - treatment) * (wages - mu0) / (1 - e)", "1"
    ),
    "att_given_scores": influence("treatment * (mu1 - mu0)", "treatment"),
    "att_augmented_given_scores": influence(
        "CASE WHEN treatment = 1 THEN wages - 1.1 * mu0 ELSE -e / (1 - e) * (wages - 1.1 * mu0) END", "treatment"
    ),
    "support_given_sds": SCORES + """, cut AS (SELECT max(CASE WHEN treatment = 1 THEN sd1 END) + 0.25 * coalesce(stddev_samp(CASE WHEN treatment = 1 THEN sd1 END), 0) AS c1,
          max(CASE WHEN treatment = 0 THEN sd0 END) + 0.25 * coalesce(stddev_samp(CASE WHEN treatment = 0 THEN sd0 END), 0) AS c0 FROM sc_all),
        z AS (SELECT treatment, CASE WHEN (treatment = 1 AND sd0 <= c1) OR (treatment = 0 AND sd1 <= c0) THEN 1 ELSE 0 END AS supported,
               CASE WHEN treatment = 1 THEN sd1 ELSE sd0 END AS f, CASE WHEN treatment = 1 THEN sd0 ELSE sd1 END AS cf FROM sc_all, cut)
        SELECT treatment, supported, count(*) AS n, """ + sig("avg(f)", "sd_factual") + ", " + sig("avg(cf)", "sd_counterfactual") + " FROM z GROUP BY 1, 2",
    "support_by_propensity": SCORES + """, cut AS (SELECT treatment AS t, min(e) AS lo, max(e) AS hi FROM sc_all GROUP BY 1)
        SELECT bl, treatment, CASE WHEN e BETWEEN lo AND hi THEN 1 ELSE 0 END AS supported, count(*) AS n
        FROM sc_all JOIN cut ON t = 1 - treatment GROUP BY 1, 2, 3""",
    "person_effects": ORDERS_COHORT + """, r AS (SELECT caseid, wages - avg(wages) OVER (PARTITION BY treatment) AS e FROM oc)
        SELECT caseid, count(*) AS n_rows, round(0.5 * count(*) / (1 + 0.5 * count(*)) * avg(e), 3) AS person_effect FROM r GROUP BY 1""",
    "att_of_draws": SCORES + """, d AS (SELECT i, avg(mu1 * (1 + i / 100) - mu0 * (1 + i / 50)) AS v FROM sc, (SELECT unnest(range(1, 6)) AS i) WHERE treatment = 1 GROUP BY i),
        r AS (SELECT avg(v) AS est, stddev_samp(v) AS sd FROM d) SELECT """
        + ", ".join([N_DROPPED, sig("est", "estimate"), sig("sd", "sd"), sig("est - 1.96 * sd", "ci_lower"), sig("est + 1.96 * sd", "ci_upper")]) + " FROM r",
    "sensitivity_grid": sensitivity(COHORT_FIT),
    "sensitivity_first_baseline": sensitivity(
        WITH_COHORT + sweep("(SELECT * FROM cohort WHERE bl = 4)", COHORT_TERMS, "log_wages")
    ),
    "robustness_value": COHORT_FIT + f""", one AS (SELECT m[1][{len(COHORT_TERMS) + 1}] AS est, sqrt(-variance * m[1][1]) AS se, df FROM fit),
        f AS (SELECT *, est / se AS t, abs(est / se) / sqrt(df) AS f FROM one)
        SELECT CAST(df AS BIGINT) AS df, """ + ", ".join([
            sig("est", "estimate"), sig("se", "se"), sig("t", "t"), sig("t * t / (t * t + df)", "partial_r2"),
            sig("(sqrt(power(f, 4) + 4 * f * f) - f * f) / 2", "robustness_value"),
        ]) + " FROM f",
    "residual_by_fitted": binned(WITHIN_SCORED, "fitted", "residual", "scored", 0, 1500000, 15),
    "residual_by_observed": binned(WITHIN_SCORED, "fitted + residual", "residual", "scored", 0, 1500000, 15),
    "individual_effects": SCORES + f"SELECT *, {N_DROPPED} FROM (" + quantile_rows(
        "", "(mu1 - mu0)", "sc", (0.1, 0.25, 0.5, 0.75, 0.9), {"all": "true", "treated": "treatment = 1"}, 3
    ) + ")",
    "support_curve": binned(SCORES, "mu1 - mu0", "mu1", "sc_all", -400000, 400000, 16),
}

_P = len(WITHIN_TERMS)
WAGES_SCORED = WITHIN_FIT + f""", lin AS (
  SELECT x{_P} AS y, avg(x{_P}) OVER (PARTITION BY g) AS yb, {" + ".join(
    f"CASE WHEN list_contains(kept, {j + 1}) THEN m[{j + 1}][{_P + 1}] * (x{j} - avg(x{j}) OVER (PARTITION BY g)) ELSE 0 END"
    for j in range(_P))} AS lin FROM fr, fit),
scored AS (SELECT yb + lin AS fitted, y - yb - lin AS residual FROM lin)
"""
ORACLES["wage_residual_by_fitted"] = binned(WAGES_SCORED, "fitted", "residual", "scored", 3, 11, 16)
ORACLES["wage_residual_by_observed"] = binned(WAGES_SCORED, "fitted + residual", "residual", "scored", 3, 11, 16)
ORACLES["cohort_individual_effects"] = (
    CROSS_FITTED + f"SELECT part, share, {sig('value', 'value')} FROM (" + quantile_rows(
        "", "(mu1 - mu0)", "trimmed", (0.1, 0.25, 0.5, 0.75, 0.9),
        {"all": "true", "treated": "treatment = 1", "supported": "supported = 1"}, None,
    ) + ")"
)
ORACLES["cohort_support_curve"] = binned(CROSS_FITTED, "mu1 - mu0", "mu1", "scored", -4, 4, 16)

TWO_FITS = (
    sweep("sample1", WITHIN_TERMS, "log_wages", "caseid", "_w")
    + sweep("sample2", {**plain(*NAIVE), **REGION_DUMMIES}, "log_wages", None, "_c")
    + f""", two AS (
        SELECT 'Within' AS model, m[2][{len(WITHIN_TERMS) + 1}] AS att, sqrt(-variance * m[2][2]) AS sd FROM fit_w
        UNION ALL
        SELECT 'Naive OLS', m[1][{len(NAIVE) + len(REGION_DUMMIES) + 1}], sqrt(-variance * m[1][1]) FROM fit_c)
"""
)
EFFECT_ROW = ", ".join(
    ["model", sig("att", "att"), sig("sd", "sd"), sig("att - 1.96 * sd", "ci_lower"), sig("att + 1.96 * sd", "ci_upper")]
)
ORACLES["effect_table"] = PANEL + SAMPLE_ONE + SAMPLE_TWO + cohort_cte() + TWO_FITS + f"SELECT {EFFECT_ROW} FROM two"
ORACLES["effect_table_all"] = (
    PANEL + SAMPLE_ONE + SAMPLE_TWO + cohort_cte() + TWO_FITS
    + sql_fits.cross_fitted("cohort", EFFECT_TERMS, "log_wages", "treatment") + sql_fits.bootstrap(poisson_cuts(), REPLICATES)
    + f"SELECT {EFFECT_ROW} FROM (SELECT * FROM two UNION ALL SELECT 'Cross-fitted', est, sd FROM drawn)"
)
