"""Whole reports: every table of a report as lines of text, so that one query shows all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.catalog.bindings import WEAK, tickets, weak_labels
from trendloom.catalog.registry import query
from trendloom.operators.ordering import union_all
from trendloom.plans import reports
from trendloom.sources.taxonomy import Taxonomy


def lines(report: dict[str, DataFrame], shown: dict[str, list[str]]) -> DataFrame:
    """(section, line): the named columns of each table, or all of them, joined by bars."""

    def text(df: DataFrame, name: str):
        kind = df.schema[name].dataType.typeName()
        exact = F.round(name, 6).cast("decimal(18,6)") if kind == "double" else F.col(name)
        return F.coalesce(exact.cast("string"), F.lit("-"))

    return union_all([
        df.select(F.lit(section).alias("section"), F.concat_ws("|", *[text(df, c) for c in shown.get(section, df.columns)]).alias("line"))
        for section, df in report.items()
    ])


def sql_lines(sections: dict[str, tuple[str, list[str]]]) -> str:
    """The same lines from (SELECT, columns) of every section; numbers with a fraction end in ``:d``."""
    parts = []
    for section, (select, columns) in sections.items():
        cells = [
            f"coalesce(CAST(CAST(round({c[:-2]}, 6) AS DECIMAL(18,6)) AS VARCHAR), '-')" if c.endswith(":d")
            else f"coalesce(CAST({c} AS VARCHAR), '-')" for c in columns
        ]
        parts.append(f"SELECT '{section}' AS section, {' || chr(124) || '.join(cells)} AS line FROM ({select})")
    return "\nUNION ALL ".join(parts)


def top(column: str, k: int, where: str = "is_complaint_llm", source: str = "weak") -> str:
    return (
        f'SELECT {column} AS v, count(*) AS n FROM {source} WHERE {where} AND {column} IS NOT NULL '
        f'GROUP BY 1 ORDER BY n DESC, v LIMIT {k}'
    )


TOTALS = """SELECT count(*) AS n, count(*) FILTER (WHERE is_complaint_llm) AS c,
       coalesce(avg(CAST(is_complaint_llm AS INTEGER)), 0) AS s FROM weak"""


def labelled(df: DataFrame) -> DataFrame:
    return weak_labels(df).withColumns({"short_summary_llm": F.col("dialog_text"), "loan_product_llm": F.col("product")})


@query(
    "pilot_report",
    "WITH " + WEAK + " " + sql_lines({
        "totals": (TOTALS, ["n", "c", "s:d"]),
        "top_categories": (top("complaint_category_llm", 10), ["v", "v || ' (' || v || ')'", "n"]),
        "complaint_examples": ("SELECT row_id FROM weak WHERE is_complaint_llm ORDER BY row_id LIMIT 30", ["row_id"]),
        "other_examples": ("SELECT row_id FROM weak WHERE NOT is_complaint_llm ORDER BY row_id LIMIT 30", ["row_id"]),
        "warning": ("SELECT coalesce(bool_or(regexp_matches(dialog_text, '(?i)CLIENT|OPERATOR|CHATBOT')), false) AS w FROM weak", ["w"]),
        "top_subcategories": (top("complaint_subcategory_llm", 10), ["v", "v || ' (' || v || ')'", "n"]),
        "top_loan_products": (top("product", 10), ["v", "v || ' (' || v || ')'", "n"]),
    }),
)
def pilot_report(spark, sf_dir):
    """Codes that the taxonomy does not know stand for their own label."""
    report = reports.pilot(labelled(tickets(spark, sf_dir)), Taxonomy.default())
    return lines(report, {"complaint_examples": ["row_id"], "other_examples": ["row_id"]})


@query(
    "training_report",
    "WITH " + WEAK + ", bad AS (SELECT * FROM weak WHERE is_complaint_llm) " + sql_lines({
        "predicted_complaints": ("SELECT status = 'F' AS p, count(*) AS n FROM weak GROUP BY 1", ["p", "n"]),
        "categories": (top("complaint_category_llm", 20, "true", "bad"), ["v", "n"]),
        "subcategories": (top("complaint_subcategory_llm", 25, "true", "bad"), ["v", "n"]),
        "daily": (
            "SELECT CAST(date_trunc('day', event_time) AS TIMESTAMP) AS day, count(DISTINCT complaint_category_llm) AS c, "
            "count(DISTINCT complaint_subcategory_llm) AS s FROM bad WHERE event_time >= TIMESTAMP '1997-01-01' "
            "AND event_time <= TIMESTAMP '1999-01-01' GROUP BY 1", ["day", "c", "s"],
        ),
    }),
)
def training_report(spark, sf_dir):
    val = weak_labels(tickets(spark, sf_dir)).withColumns({"pred": F.col("status") == "F", "y_cat": F.col("channel")})
    return lines(reports.training(val, val.filter("is_complaint_llm"), "1997-01-01", "1999-01-01"), {})


@query(
    "month_report",
    "WITH " + WEAK + " " + sql_lines({
        "totals": (TOTALS, ["n", "c", "s:d"]),
        "quality": (
            "SELECT coalesce(avg(CASE WHEN trim(coalesce(dialog_text, ''), ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 1 ELSE 0 END), 0) AS a, "
            "coalesce(avg(CASE WHEN status = 'P' THEN 1 ELSE 0 END), 0) AS b FROM weak", ["a:d", "b:d"],
        ),
        "categories": (top("lang", 1_000_000), ["v", "n"]),
        "subcategories": (top("complaint_subcategory_llm", 1_000_000), ["v", "n"]),
        "top_categories": (top("lang", 20), ["v", "n"]),
        "top_subcategories": (top("complaint_subcategory_llm", 25), ["v", "n"]),
        "examples": ("SELECT row_id FROM weak WHERE is_complaint_llm ORDER BY row_id LIMIT 50", ["row_id"]),
    }),
)
def month_report(spark, sf_dir):
    scored = weak_labels(tickets(spark, sf_dir)).select(
        "row_id", F.col("is_complaint_llm").alias("is_complaint_pred"), F.col("lang").alias("category_pred"),
        F.col("complaint_subcategory_llm").alias("subcategory_pred"), F.col("dialog_text").alias("raw_dialog"),
        F.when(F.col("status") == "P", " \t").otherwise(F.col("row_id")).alias("client_first_message"),
    )
    return lines(reports.month(scored), {"examples": ["row_id"]})


MONTHS = 'SELECT month, complaint_category_llm AS v, count(*) AS n FROM weak WHERE is_complaint_llm GROUP BY 1, 2'


@query(
    "trends_report",
    "WITH " + WEAK + """, m AS (
  SELECT month, avg(CAST(is_complaint_llm AS INTEGER)) AS r, count(*) AS n FROM weak GROUP BY month),
p AS (
  SELECT m.*, b.r AS before FROM m
  LEFT JOIN m b ON b.month = strftime(strptime(m.month || '-01', '%Y-%m-%d') - INTERVAL 1 MONTH, '%Y-%m')) """ + sql_lines({
        "monthly": ("SELECT * FROM p", ["month", "r:d", "n", "before:d", "r - before:d"]),
        "by_category": (MONTHS, ["month", "v", "n"]),
        "first_by_category": (MONTHS + " ORDER BY month, v LIMIT 100", ["month", "v", "n"]),
    }),
)
def trends_report(spark, sf_dir):
    return lines(reports.trend(weak_labels(tickets(spark, sf_dir))), {})


@query(
    "comparison_report",
    "WITH " + WEAK + """, bad AS (SELECT * FROM weak WHERE is_complaint_llm),
base AS (SELECT channel AS v, count(*) / sum(count(*)) OVER () AS s FROM bad WHERE month < '1998-01' GROUP BY 1),
fresh AS (SELECT channel AS v, count(*) / sum(count(*)) OVER () AS s FROM bad WHERE month >= '1998-01' GROUP BY 1),
novel AS (SELECT row_id, doc_id % 3 AS cluster_id FROM bad WHERE month >= '1998-01' AND amount > 150000) """ + sql_lines({
        "share_deltas": (
            "SELECT coalesce(b.v, f.v) AS v, coalesce(b.s, 0) AS b, coalesce(f.s, 0) AS f FROM base b FULL JOIN fresh f ON b.v = f.v",
            ["v", "b:d", "f:d", "(f - b) * 100:d"],
        ),
        "novel_examples": ("SELECT row_id FROM novel ORDER BY row_id LIMIT 100", ["row_id"]),
        "topics": ("SELECT cluster_id, count(*) AS n FROM novel GROUP BY 1 HAVING count(*) >= 5", ["cluster_id", "n"]),
    }),
)
def comparison_report(spark, sf_dir):
    bad = weak_labels(tickets(spark, sf_dir)).filter("is_complaint_llm")
    new = bad.filter("month >= '1998-01'").withColumns({
        "category_pred": F.col("channel"), "is_novel": F.col("amount") > 150000, "cluster_id": F.col("doc_id") % 3
    })
    return lines(reports.comparison(bad.filter("month < '1998-01'"), new, 5), {"novel_examples": ["row_id"]})
