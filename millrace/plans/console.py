"""A small console: `python -m millrace.plans.console DIR` reads statements that end in `;`."""

from __future__ import annotations

import sys

from pyspark.errors import PySparkException

from ..session import local_session
from .sql import ParseError, query, result_lines


def main(sf_dir: str) -> None:
    spark, text = local_session(), ""
    for line in sys.stdin:
        text += line
        if ";" not in line:
            continue
        statement, text = text.strip().rstrip(";"), ""
        if statement.lower() in ("exit", "quit"):
            break
        try:
            for row in result_lines(query(spark, sf_dir, statement)):
                print(row)
        except (ParseError, PySparkException) as error:
            print(error)


if __name__ == "__main__":
    main(sys.argv[1])
