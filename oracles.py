"""SQL for every registered query, written independently of how Spark computes it.

Summaries are built the long way: one filtered count per period, full outer joins between
the five, and a plain window for the rank.
"""

from __future__ import annotations

FACTS = """
extract AS (
  SELECT o_orderdate, o_orderstatus AS status, o_orderpriority AS fuel,
         p_brand AS maker, p_type AS model, p_partkey AS part
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey
),
facts AS (
  SELECT *, CAST(date_trunc('month', o_orderdate) AS DATE) AS date_reg,
         CASE fuel WHEN '1-URGENT' THEN 'Urgent'
                   WHEN '2-HIGH' THEN 'Expedited'
                   WHEN '3-MEDIUM' THEN 'Expedited'
                   ELSE 'Others' END AS fuel_grouped
  FROM extract
)"""

TWO_YEARS = f"""{FACTS.replace("facts AS", "all_facts AS")},
facts AS (SELECT * FROM all_facts WHERE year(date_reg) IN (2000, 2001))"""

REFRESHED = f"""{FACTS.replace("facts AS", "first AS")},
again AS (SELECT * FROM first WHERE date_reg = DATE '2001-07-01' AND fuel <> '1-URGENT'),
facts AS (
  SELECT date_reg, maker, model, fuel, fuel_grouped FROM first
  WHERE date_reg IS NULL OR date_reg <> DATE '2001-07-01'
  UNION ALL SELECT date_reg, maker, model, fuel, fuel_grouped FROM again
  UNION ALL SELECT DATE '2002-07-01', maker, model, fuel, fuel_grouped FROM again
  WHERE fuel = '5-LOW'
)"""

SHIPMENTS = """
facts AS (
  SELECT l_suppkey, l_returnflag,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS date_reg
  FROM lineitem
)"""

LATEST = "(SELECT max(date_reg) FROM facts)"

PERIOD_FILTERS = {
    "current": "date_reg = l",
    "previous": "date_reg = l - INTERVAL 1 MONTH",
    "previous_year": "date_reg = l - INTERVAL 12 MONTH",
    "ytd_current": "date_reg >= date_trunc('year', l) AND date_reg <= l",
    "ytd_previous": "date_reg >= date_trunc('year', l) - INTERVAL 1 YEAR"
    " AND date_reg <= l - INTERVAL 1 YEAR",
}


def _day(date: str | None) -> str:
    return LATEST if date is None else f"DATE '{date}'"


def _period(period: str, keys: str, as_of: str | None) -> str:
    return f"""
{period}_rows AS (
  SELECT {keys}, count(*) AS count_{period}
  FROM facts, (SELECT {_day(as_of)} AS l)
  WHERE {PERIOD_FILTERS[period]} GROUP BY {keys}
)"""


def _counts(keys: str, as_of: str | None) -> str:
    """CTEs of the five period tables and of their full outer join."""
    tables = ",".join(_period(period, keys, as_of) for period in PERIOD_FILTERS)
    joins = " ".join(
        f"FULL JOIN {period}_rows USING ({keys})" for period in list(PERIOD_FILTERS)[1:]
    )
    columns = ", ".join(f"coalesce(count_{p}, 0) AS count_{p}" for p in PERIOD_FILTERS)
    seen = " ".join(
        f"WHEN count_{p} IS NOT NULL THEN {i}" for i, p in enumerate(PERIOD_FILTERS)
    )
    return f"""{tables},
counts AS (
  SELECT {keys}, {columns}, CASE {seen} END AS first_seen
  FROM current_rows {joins}
)"""


def _order(keys: str) -> str:
    keys = ", ".join(f"{key} ASC NULLS LAST" for key in keys.split(", "))
    return f"count_current DESC, first_seen, {keys}"


def _growth(current: str, earlier: str) -> str:
    return f"CASE WHEN {earlier} > 0 THEN {current} / {earlier} - 1 END"


def _ranked(keys: str) -> str:
    return f"""
SELECT row_number() OVER (ORDER BY {_order(keys)}) AS rank, {keys},
       count_current, count_previous,
       {_growth("count_current", "count_previous")} AS growth_MoM,
       count_previous_year,
       {_growth("count_current", "count_previous_year")} AS growth_YoY,
       count_ytd_current, count_ytd_previous,
       {_growth("count_ytd_current", "count_ytd_previous")} AS growth_YTD
FROM counts"""


def _summary(keys: str, as_of: str | None = None, facts: str = FACTS) -> str:
    return f"WITH {facts}, {_counts(keys, as_of)} {_ranked(keys)}"


def _top(keys: str, n: int = 10) -> str:
    return f"(SELECT {keys} FROM counts ORDER BY {_order(keys)} LIMIT {n})"


def _trend_makes(as_of: str | None, facts: str = FACTS) -> str:
    return f"""WITH {facts}, {_counts("maker", as_of)}
SELECT date_reg AS month, maker, count(*) AS registration FROM facts
WHERE maker IN {_top("maker")} GROUP BY ALL"""


def _trend_models(as_of: str | None, dedup: bool = False) -> str:
    keys = "maker, model, fuel_grouped"
    distinct = "DISTINCT" if dedup else ""
    return f"""WITH {FACTS}, {_counts(keys, as_of)},
leaders AS (SELECT {distinct} maker, model FROM {_top(keys)})
SELECT date_reg AS month, maker, model, count(*) AS registration,
       maker || ' ' || model AS make_model
FROM facts JOIN leaders USING (maker, model) GROUP BY ALL"""


def _percent(growth: str) -> str:
    """Rounded as a decimal, from the digits of the binary value; halves go away from zero."""
    x = f"CAST(format('{{:.20f}}', {growth} * 100) AS DECIMAL(38, 20))"
    return f"format('{{:,.1f}}', CAST(round({x}, 1) AS DOUBLE)) || '%'"


def _display(
    keys: dict[str, str],
    as_of: str | None,
    labels: tuple[str, str, str, str, str],
    where: str = "true",
) -> str:
    """Labelled summary; the labels are those of the data's latest or given month."""
    current, previous, previous_year, ytd_current, ytd_previous = labels

    def shown(growth: str, label: str) -> str:
        return f"""{growth} AS "{label}",
       CASE WHEN {growth} IS NOT NULL THEN {_percent(growth)} END AS "{label} text",
       CASE WHEN {growth} <= 0 THEN 'red' WHEN {growth} > 0 THEN 'green' END AS "{label} color" """

    names = ", ".join(f'{key} AS "{label}"' for key, label in keys.items())
    return f"""WITH {FACTS}, {_counts(", ".join(keys), as_of)},
ranked AS ({_ranked(", ".join(keys))})
SELECT rank AS "Rank", {names}, count_current AS "{current}", count_previous AS "{previous}",
       {shown("growth_MoM", "Growth (MoM)")}, count_previous_year AS "{previous_year}",
       {shown("growth_YoY", "Growth (YoY)")}, count_ytd_current AS "{ytd_current}",
       count_ytd_previous AS "{ytd_previous}", {shown("growth_YTD", "Growth (YTD)")}
FROM ranked WHERE {where}"""


LATEST_LABELS = ("Aug-2001", "Jul-2001", "Aug-2000", "YTD 2001", "YTD 2000")
FULL_MONTH_LABELS = ("Jul-2001", "Jun-2001", "Jul-2000", "YTD 2001", "YTD 2000")

MAKE = {"maker": "Make"}
MODEL = {"maker": "Make", "model": "Model", "fuel_grouped": "Fuel Type"}
FUEL = {"fuel_grouped": "Fuel Type"}

MEASURES = (
    "count_current, count_previous, growth_MoM, count_previous_year, growth_YoY,"
    " count_ytd_current, count_ytd_previous, growth_YTD"
)


def _dashboard_summaries() -> str:
    """Each summary as a nested query, as all three define the same period tables."""
    make, model, fuel = (
        f"(WITH {_counts(keys, None)} {_ranked(keys)})"
        for keys in ("maker", "maker, model, fuel_grouped", "fuel_grouped")
    )
    return f"""WITH {FACTS}
SELECT 'make' AS page, rank, maker, NULL::VARCHAR AS model, NULL::VARCHAR AS fuel_grouped,
       {MEASURES} FROM {make}
UNION ALL
SELECT 'model', rank, maker, model, fuel_grouped, {MEASURES} FROM {model}
UNION ALL
SELECT 'fuel', rank, NULL, NULL, fuel_grouped, {MEASURES} FROM {fuel}"""


def _dashboard_trends() -> str:
    make = _trend_makes("2001-01-01")
    model = _trend_models("2001-01-01")
    return f"""WITH {FACTS}
SELECT 'make' AS page, month, maker, NULL::VARCHAR AS model, NULL::VARCHAR AS fuel_grouped,
       registration FROM ({make})
UNION ALL
SELECT 'model', month, maker, model, NULL, registration FROM ({model})
UNION ALL
SELECT 'fuel', date_reg, NULL, NULL, fuel_grouped, count(*) FROM facts GROUP BY ALL"""


def _simple(select: str) -> str:
    return f"WITH {FACTS} {select}"


REPORTING_CALENDAR = _simple(
    f"""
SELECT l AS month_current,
       CAST(l - INTERVAL 1 MONTH AS DATE) AS month_previous,
       CAST(l - INTERVAL 12 MONTH AS DATE) AS month_previous_year,
       year(l) AS year_current,
       CAST(make_date(year(l), 1, 1) AS DATE) AS ytd_current_start,
       l AS ytd_current_end,
       CAST(make_date(year(l) - 1, 1, 1) AS DATE) AS ytd_previous_start,
       CAST(l - INTERVAL 1 YEAR AS DATE) AS ytd_previous_end,
       strftime(l, '%b-%Y') AS label_current,
       strftime(l - INTERVAL 1 MONTH, '%b-%Y') AS label_previous,
       strftime(l - INTERVAL 12 MONTH, '%b-%Y') AS label_previous_year,
       'YTD ' || strftime(l, '%Y') AS label_ytd_current,
       'YTD ' || strftime(l - INTERVAL 1 YEAR, '%Y') AS label_ytd_previous
FROM (SELECT {LATEST} AS l)"""
)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for every registered query."""
    model_keys = "maker, model, fuel_grouped"
    return {
        "as_of_date": _simple(
            "SELECT max(date_reg) AS as_of, count(*) AS n_rows,"
            " count(*) FILTER (WHERE date_reg IS NULL) AS n_null_dates FROM facts"
        ),
        "reporting_calendar": REPORTING_CALENDAR,
        "date_functions": """
SELECT CAST(o_orderdate AS DATE) AS day,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
       CAST(date_trunc('year', o_orderdate) AS DATE) AS year_start,
       year(o_orderdate) AS year_number,
       CAST(o_orderdate - INTERVAL 1 MONTH AS DATE) AS month_before,
       CAST(o_orderdate - INTERVAL 1 YEAR AS DATE) AS year_before,
       CAST(o_orderdate - INTERVAL 3 YEAR AS DATE) AS three_years_before,
       strftime(o_orderdate, '%b-%Y') AS month_text,
       'YTD ' || strftime(o_orderdate, '%Y') AS ytd_text,
       count(*) AS count
FROM orders GROUP BY ALL""",
        **{
            f"count_{period}": _simple(
                f", {_period(period, 'maker', None)} SELECT * FROM {period}_rows"
            )
            for period in PERIOD_FILTERS
        },
        **{
            f"period_counts_{page}": f"WITH {FACTS}, {_counts(keys, None)}"
            " SELECT * EXCLUDE (first_seen) FROM counts"
            for page, keys in (
                ("make", "maker"),
                ("model", model_keys),
                ("fuel", "fuel_grouped"),
            )
        },
        "count_current_full_month": _simple(
            f", {_period('current', 'maker', '2001-07-01')} SELECT * FROM current_rows"
        ),
        "combined_counts": f"WITH {SHIPMENTS}, {_counts('l_suppkey, l_returnflag', '2001-01-01')}"
        " SELECT * EXCLUDE (first_seen) FROM counts",
        "summary_by_make": _summary("maker"),
        "summary_by_model": _summary(model_keys),
        "summary_by_fuel": _summary("fuel_grouped"),
        "summary_by_make_full_month": _summary("maker", "2001-07-01"),
        "summary_by_model_january": _summary(model_keys, "2001-01-01"),
        "summary_by_fuel_first_year": _summary("fuel_grouped", "1995-06-01"),
        "summary_by_part": _summary("part, maker, model", "2001-08-01"),
        "summary_by_shipment": _summary(
            "l_suppkey, l_returnflag", "2001-07-01", SHIPMENTS
        ),
        "summary_of_events": _summary(
            "event_type",
            None,
            "facts AS (SELECT event_type,"
            " CAST(date_trunc('month', ts) AS DATE) AS date_reg FROM events)",
        ),
        "top_makes": f"WITH {FACTS}, {_counts('maker', None)} SELECT * FROM {_top('maker')}",
        "top_models": f"WITH {FACTS}, {_counts(model_keys, None)}"
        f" SELECT maker, model FROM {_top(model_keys)}",
        "trend_top_makes": _trend_makes(None),
        "trend_top_makes_full_month": _trend_makes("2001-07-01"),
        "trend_top_models": _trend_models(None),
        "trend_top_models_january": _trend_models("2001-01-01"),
        "trend_top_models_january_dedup": _trend_models("2001-01-01", dedup=True),
        "trend_fuel": _simple(
            "SELECT date_reg AS month, fuel_grouped, count(*) AS registration"
            " FROM facts GROUP BY ALL"
        ),
        "rows_of_top_makes": f"WITH {FACTS}, {_counts('maker', '2001-07-01')}"
        f" SELECT maker, fuel, count(*) AS n FROM facts WHERE maker IN {_top('maker')}"
        " GROUP BY ALL",
        "rows_of_top_models": f"WITH {FACTS}, {_counts(model_keys, '2001-01-01')},"
        f" leaders AS (SELECT maker, model FROM {_top(model_keys)})"
        " SELECT maker, model, fuel, count(*) AS n"
        " FROM facts JOIN leaders USING (maker, model) GROUP BY ALL",
        "fuel_regroup": _simple(
            "SELECT fuel, fuel_grouped, count(*) AS n FROM facts GROUP BY ALL"
        ),
        "make_class": _simple(
            "SELECT maker, CASE WHEN maker IN ('Brand#11', 'Brand#23') THEN 'National'"
            " ELSE 'Non-National' END AS class, count(*) AS n FROM facts GROUP BY ALL"
        ),
        "make_model_label": _simple(
            "SELECT maker || ' ' || model AS make_model, count(*) AS n FROM facts GROUP BY ALL"
        ),
        "make_model_list": _simple("SELECT DISTINCT maker, model FROM facts"),
        "month_floor": _simple(
            "SELECT date_reg, fuel_grouped, count(*) AS n FROM facts GROUP BY ALL"
        ),
        "union_years": "SELECT year(o_orderdate) AS year,"
        " CASE WHEN year(o_orderdate) > (SELECT min(year(o_orderdate)) FROM orders)"
        " OR o_orderdate IS NULL THEN o_orderstatus END AS status,"
        " count(*) AS n FROM orders GROUP BY ALL",
        "summary_by_make_two_years": _summary("maker", None, TWO_YEARS),
        "trend_top_makes_two_years": _trend_makes(None, TWO_YEARS),
        "preview": _simple(
            "SELECT CAST(o_orderdate AS DATE) AS date_reg, maker, model, fuel, fuel_grouped"
            " FROM facts ORDER BY ALL LIMIT 6"
        ),
        "curated_build": _simple(
            "SELECT date_reg, fuel, fuel_grouped,"
            " CASE WHEN date_reg IS NULL OR date_reg < DATE '2000-01-01' THEN status END"
            " AS status,"
            " count(*) AS n FROM facts GROUP BY ALL"
        ),
        "curated_month_refresh": f"WITH {REFRESHED}"
        " SELECT date_reg, fuel, fuel_grouped, count(*) AS n FROM facts GROUP BY ALL",
        "kept_counts_refresh": _summary(model_keys, None, REFRESHED),
        "stored_calendar": REPORTING_CALENDAR,
        "extract_rejects": _simple(
            """
, rows_ AS (SELECT *, part % 7 AS kind FROM facts WHERE date_reg IS NOT NULL)
SELECT maker, 'accepted' AS reason, count(*) AS n, count(*) FILTER (WHERE kind <> 3) AS dated,
       count(DISTINCT (model, fuel)) AS kinds
FROM rows_ WHERE kind >= 3 GROUP BY ALL
UNION ALL
SELECT maker, CASE WHEN kind = 1 THEN 'date_reg' ELSE 'fields' END, count(*), NULL, NULL
FROM rows_ WHERE kind < 3 GROUP BY ALL"""
        ),
        "union_types": """
SELECT CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus
            ELSE CAST(length(o_orderstatus) AS VARCHAR) END AS o_orderstatus,
       count(*) AS n, min(key) AS first, max(key) AS last
FROM (SELECT *, CASE WHEN o_orderkey % 2 = 1 THEN '00' ELSE '' END || o_orderkey AS key FROM orders)
GROUP BY 1""",
        "curated_csv": _summary("maker"),
        "curated_csv_line_breaks": _simple(
            "SELECT maker, '\"' || model || '\"' || chr(10) || maker AS model, count(*) AS n,"
            " CAST(max(o_orderdate) AS DATE) AS last FROM facts GROUP BY ALL"
        ),
        "display_by_make": _display(MAKE, None, LATEST_LABELS),
        "display_by_model": _display(MODEL, None, LATEST_LABELS),
        "display_by_fuel": _display(FUEL, None, LATEST_LABELS),
        "display_page": _display(
            {"part": "part", "maker": "Make", "model": "Model"},
            "2001-07-01",
            FULL_MONTH_LABELS,
            "rank BETWEEN 101 AND 200",
        ),
        "display_page_by_offset": _display(
            {"part": "part", "maker": "Make", "model": "Model"},
            "2001-07-01",
            FULL_MONTH_LABELS,
            "rank BETWEEN 101 AND 200",
        ),
        "display_filtered": _display(
            MODEL,
            "2001-07-01",
            FULL_MONTH_LABELS,
            "maker ILIKE '%#2%' AND maker ILIKE '%brand%' AND count_current >= 2"
            " AND growth_MoM BETWEEN -0.5 AND 0.5",
        ),
        "dashboard_summaries": _dashboard_summaries(),
        "dashboard_trends": _dashboard_trends(),
    }
