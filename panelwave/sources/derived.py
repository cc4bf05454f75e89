"""Panels and a full wide survey derived from the star-schema test tables.

Persons are customers, a wave is a calendar quarter of 1995-2001 (27 of them), and
survey answers are functions of the customer and of the orders placed in the wave.
Everything is computed from the tables, so it grows with them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwave.functions.nullsafe import quoted
from panelwave.functions.waves import wave_to_year
from panelwave.operators.inrow import emit_rows

WAVES = range(27)
ORDER_YEARS = range(7)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_cells(
    spark: SparkSession, sf_dir: str, wave: str, waves: Sequence[int], exposing: str
) -> DataFrame:
    """One row per customer with, for each wave, the orders, cents and exposure of it.

    Orders become one row per customer and wave, then one map per customer of at most as many
    entries as there are waves. Both steps combine on the map side, so a customer holding a large
    share of all orders is a few rows of each task. ``wave`` and ``exposing`` are expressions over
    the orders. A wave without orders has nulls.
    """
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS c_custkey",
        f"CAST({wave} AS INT) AS wave",
        "CAST(round(o_totalprice * 100) AS BIGINT) AS cents",
        f"CAST({exposing} AS INT) AS inc",
    )
    by_wave = orders.where(f"wave BETWEEN {waves[0]} AND {waves[-1]}").groupBy("c_custkey", "wave").agg(
        F.count("*").alias("n"), F.sum("cents").alias("cents"), F.max("inc").alias("inc")
    )
    by_customer = by_wave.groupBy("c_custkey").agg(
        F.map_from_entries(F.collect_list(F.struct("wave", F.struct("n", "cents", "inc")))).alias("cells")
    )
    customer = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "c_nationkey", "CAST(round(c_acctbal * 100) AS BIGINT) AS bal"
    )
    cells = [f"cells[{k}].{part} AS {part}_{k}" for k in waves for part in ("n", "cents", "inc")]
    # narrow rows so far; what is made of them is wide, so all tasks get a share however few bytes these are
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = customer.join(by_customer, "c_custkey", "left").repartition(tasks, "c_custkey")
    return spread.selectExpr("c_custkey", "c_nationkey", "bal", *cells)


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer x year (0..6), every cell present: wages, jobs and exposure."""
    cells = customer_cells(
        spark,
        sf_dir,
        "year(o_orderdate) - 1995",
        ORDER_YEARS,
        "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
    )
    rows = [
        {
            "wave": str(w),
            "wages": f"cents_{w} / 100",
            "n_jobs": f"CASE WHEN n_{w} > 0 THEN n_{w} END",
            "incarcerated": f"coalesce(inc_{w}, 0)",
        }
        for w in ORDER_YEARS
    ]
    return emit_rows(cells.withColumnRenamed("c_custkey", "caseid"), ["caseid"], rows)


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User x day (0..29) with records: weeks worked, exposure, welfare and drugs.

    Events become cells by a ``groupBy`` that combines on the map side, so a very
    active user is one row per day in everything that follows.
    """
    return spark.sql(
        """
        SELECT user_id AS caseid, datediff(ts, DATE '2024-01-01') AS wave,
               count(*) AS weeks_worked,
               max(CASE WHEN event_type = 'error' THEN 1 END) AS incarcerated,
               sum(CASE WHEN event_type = 'purchase'
                        THEN CAST(round(value * 100) AS BIGINT) END) / 100 AS welfare,
               max(CASE WHEN event_type = 'signup'
                        THEN CAST(round(value * 100) AS BIGINT) END) AS drugs
        FROM {events} GROUP BY 1, 2
        """,
        events=table(spark, sf_dir, "events"),
    )


def cases(*pairs: tuple[str, object], otherwise: object) -> str:
    """First matching (condition, value) pair."""
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {otherwise} END"


def suffixed(stem: str, k: int) -> str:
    return stem if k == 0 else f"{stem}.{k}"


def survey_answers() -> dict[str, str]:
    """The survey answers as expressions over :func:`customer_cells`.

    Codes -1 to -5 stand for missing answers, as in a raw survey.
    """
    c, nation = "c_custkey", "c_nationkey"

    def n(k: int) -> str:
        return f"coalesce(n_{k}, 0)"

    def absent(k: int) -> str:
        return f"({c} * 7 + {k * 5}) % 19 = 0"

    out: dict[str, str] = {}
    for k in WAVES:
        year = wave_to_year(k)
        away = (absent(k), -5)
        out[suffixed("AGEATINT", k)] = cases(away, otherwise=f"{16 + year - 1979} + {c} % 8")
        out[suffixed("HH1.1", k)] = cases(
            (f"inc_{k} = 1", 5), away, (f"{n(k)} > 0", f"1 + {c} % 4"), otherwise=-4
        )
        stem, start = (
            ("Q13.5", 0) if k < 3 else ("Q13.5_TRUNC_REVISED", 3) if k < 19 else ("Q13.5_TRUNC", 19)
        )
        out[suffixed(stem, k - start)] = cases(
            away,
            (f"({c} + {k}) % 29 = 0", -1),
            (f"{n(k)} > 0 AND ({c} + {k}) % 31 = 0", -9),  # an answer below the missing codes
            (f"{n(k)} > 0", f"floor(cents_{k} / 1000)"),
            otherwise=-4,
        )
        out[suffixed("POVSTATUS", k)] = cases(
            away, (f"({c} + {k}) % 13 = 0", -3), otherwise=f"({nation} + {k}) % 2"
        )
        out[suffixed("URBAN.RURAL", k)] = cases(
            away, (f"({c} + {k}) % 17 = 0", -4), otherwise=f"({c} + {k // 4}) % 2"
        )
        out[suffixed("HGC", k)] = cases(
            away, otherwise=f"{8 + min(k // 4, 3)} + ({c} * 3 + {c} % 7) % 9"
        )
        out[f"ENROLLMTREV{year % 100:02d}"] = cases(away, otherwise=f"1 + ({c} * 3 + {k}) % 4")
        out[suffixed("WKSWK.PCY", k)] = cases(away, otherwise=f"{n(k)} * 9")
        out[suffixed("MARSTAT.KEY", k)] = cases(away, otherwise=f"1 + ({c} + {k // 6}) % 3")
        out[f"EMPLOYERS_ALL_UNION_{year}.01"] = cases(
            (f"{n(k)} = 0", -4), (f"{n(k)} > 1", 1), otherwise=0
        )
        out[f"EMPLOYERS_ALL_UNION_{year}.02"] = cases(
            (absent(k), -4), (f"({nation} + {k}) % 3 = 0", 1), otherwise=0
        )
        if k <= 18:
            held = 21 if k == 18 else k
            out[suffixed("ESR_KEY", k)] = cases(
                (absent(held), -5),
                (f"{n(held)} > 1", 1),
                (f"{n(held)} = 1", 2),
                (f"({c} + {held}) % 5 = 0", 3),
                (f"({c} + {held}) % 31 = 0", 8),
                otherwise=4,
            )
        worker = "CPS.QES.56C" if k < 15 else "QES.56C.01"
        out[suffixed(worker, k if k < 15 else k - 15)] = cases(
            away, otherwise=f"1 + ({nation} + {k}) % 3"
        )
        out[suffixed("REGION", k)] = cases(away, otherwise=f"1 + {nation} % 4")
        industry = cases(
            (f"{n(k)} = 0", -4), otherwise=f"({nation} * 37 + {k * 11} + {c} % 13) % 950"
        )
        if k < 15:
            out[suffixed("CPSIND70", k)] = industry
        if k >= 10:
            out[suffixed("INDALL.EMP.01", k)] = industry
        out[suffixed("HRP1", k)] = cases(
            (f"{n(k)} > 0", f"floor(cents_{k} / 10000)"), away, otherwise=-4
        )
        amount = f"(10 + ({c} * 13 + {k * 7}) % 900)"
        out[f"WELFARE.AMT.{year}_TOT"] = cases(
            away,
            (f"{n(k)} > 0", 0),
            (f"({c} + {k}) % 97 = 0", f"{amount} * 50"),
            (f"({c} + {k}) % 3 = 0", amount),
            otherwise=-4,
        )
    for j in range(5):
        out[suffixed("DS.11", j)] = cases(
            (f"({c} + {j}) % 6 = 0", -4), (f"({c} + {j}) % 11 = 0", 1), otherwise=0
        )
        out[suffixed("DS.15", j)] = cases(
            (f"({c} + {j}) % 5 = 0", -2), (f"({c} * 3 + {j}) % 13 = 0", 1), otherwise=0
        )
    for j in range(3):
        out[suffixed("DS.19", j)] = cases(
            (f"({c} + {j}) % 7 = 0", -4), (f"({c} + {j}) % 4 = 0", 1), otherwise=0
        )
    out["DRUG.1"] = cases((f"{c} % 23 = 0", 1), otherwise=0)
    out["SAMPLE_RACE"] = f"{nation} % 3 + 1"
    out["SAMPLE_SEX"] = f"{c} % 2 + 1"
    out["AFQT.1"] = cases(("bal < 0", -4), otherwise="floor(bal / 10)")
    out["POLICE.1"] = cases((f"{c} % 9 = 0", -4), otherwise=f"floor({c} / 2) % 2")
    out["POLICE.2"] = cases((f"{c} % 3 = 0", -4), otherwise=f"floor({c} / 4) % 2")
    out["POLICE.3"] = cases((f"{c} % 4 = 0", -4), (f"{c} % 10 = 1", 1), otherwise=0)
    out["POLICE.6"] = cases((f"{c} % 5 = 0", -2), (f"floor({c} / 3) % 4 = 0", 1), otherwise=0)
    out["POLICE.7"] = cases((f"{c} % 6 = 0", -4), (f"floor({c} / 5) % 8 = 0", 1), otherwise=0)
    return out


def survey_wide(spark: SparkSession, sf_dir: str, dtype: str = "DOUBLE") -> DataFrame:
    """The wide survey: one row per customer, some 480 answer columns as ``dtype``.

    A wave is a calendar quarter. Every answer is a whole number, so BIGINT holds the same answers.
    """
    answers = survey_answers()
    cells = customer_cells(
        spark,
        sf_dir,
        "(year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) - 1",
        WAVES,
        "o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')",
    )
    return cells.selectExpr(
        "c_custkey AS CASEID", *[f"CAST({answers[c]} AS {dtype}) AS {quoted(c)}" for c in answers]
    )


def repeated_headers(columns: list[str]) -> list[str]:
    """Header fields that repeat a name for each of its suffixes 1, 2, ... in turn, told apart by blanks.

    A reader that trims its header fields finds the same name again and again, as in a survey file
    whose questions were asked in every wave.
    """
    asked: dict[str, int] = {}
    out = []
    for column in columns:
        stem, _, repeat = column.rpartition(".")
        if stem in asked and repeat == str(asked[stem] + 1):
            asked[stem] += 1
            out.append(stem + " " * asked[stem])
        else:
            out.append(column)
            asked[column] = 0
    return out
