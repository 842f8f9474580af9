"""SQL entry point, result formatting and plan inspection."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, islice

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from ..sources import catalog

LOGICAL = "org.apache.spark.sql.catalyst.plans.logical"


class ParseError(ValueError):
    """A statement that can't be run: `code` names the fault, `line` and `column` (from 1) where it is, if known."""

    def __init__(self, message: str, code: str | None = None, line: int | None = None, column: int | None = None):
        super().__init__(message)
        self.code, self.line, self.column = code, line, column


def _check_is_query(spark: SparkSession, text: str) -> None:
    """Parse without running: Spark would carry out a command, such as an INSERT, at once."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as error:
        message = str(error)
        at = re.search(r"\(line (\d+), pos (\d+)\)", message)
        line, column = (int(at[1]), int(at[2]) + 1) if at else (None, None)
        raise ParseError(message, error.getCondition(), line, column) from None
    if any(spark._jvm.java.lang.Class.forName(f"{LOGICAL}.{kind}").isInstance(plan) for kind in ("Command", "ParsedStatement")):
        raise ParseError(f"{plan.nodeName()} is no query; the operators in millrace.operators.dml change tables", "NOT_A_QUERY", 1, 1)


def query(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run SQL over the tables of a directory. The dialect is Spark's, a superset of
    SELECT-FROM-WHERE-GROUP BY-HAVING-ORDER BY with aliases and sub-queries in FROM. Statements that would
    change tables are refused."""
    _check_is_query(spark, text)
    words = set(re.findall(r"\w+", text.lower()))
    catalog.register(spark, sf_dir, [t for t in (*catalog.TABLES, catalog.BRIDGE) if t in words])
    return spark.sql(text)


def same_result(a: DataFrame, b: DataFrame) -> bool:
    """Structural equality: whether the analysed plans are the same up to names and order of conjuncts."""
    return a.sameSemantics(b)


def explain(df: DataFrame) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def result_lines(df: DataFrame, ahead: int = 1000) -> Iterator[str]:
    """Header, fixed-width rows and their number, for a console. All rows are fetched, a partition at a time;
    the first `ahead` of them decide the widths."""
    rows = ([("NULL" if v is None else str(v)) for v in r] for r in df.toLocalIterator(prefetchPartitions=True))
    first = list(islice(rows, ahead))
    widths = [max([len(c), *(len(r[i]) for r in first)]) for i, c in enumerate(df.columns)]
    line = lambda cells: " | ".join(c.ljust(w) for c, w in zip(cells, widths)).rstrip()
    yield line(df.columns)
    yield "-+-".join("-" * w for w in widths)
    n = 0
    for row in chain(first, rows):
        n += 1
        yield line(row)
    yield f"{n} rows returned."


def result_text(df: DataFrame) -> str:
    return "\n".join(result_lines(df))
