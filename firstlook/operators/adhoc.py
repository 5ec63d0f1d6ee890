"""Ad-hoc queries on a cleaned table, with a bounded result."""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import dataclass, field
from typing import Any, Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import TIME_TYPES
from .charts import bounded_figure

# Rows of a result that are shown, and seconds a query may take.
MAX_RESULT_ROWS = 1_000
TIMEOUT_S = 10.0
CANCEL_EVERY_S = 0.2

Query = str | Callable[[DataFrame], Any]


@dataclass
class Result:
    type: str = "none"  # none, scalar or dataframe
    value: Any = None
    columns: list[str] = field(default_factory=list)
    records: list[dict] = field(default_factory=list)
    truncated: bool = False


@dataclass
class Answer:
    result: Result
    figure: dict | None = None
    error: str | None = None


def run_query(df: DataFrame, query: Query, timeout_s: float = TIMEOUT_S) -> Answer:
    """Run SQL over the table, named ``{df}``, or a function of it, and format what comes back.

    The query itself runs on the whole table; only the result shown is cut, to its first 1000 rows, and says so. It runs in a thread of its own, whose
    jobs carry a tag. After ``timeout_s`` seconds the answer is an error, jobs of that tag are cancelled for as long as the thread lives, and
    nothing is made of what it returns. A function of Python that does not end cannot be stopped, but gets no job done any more.
    """
    spark, tag = df.sparkSession, f"adhoc-{uuid.uuid4().hex}"
    context, late, ended, answers = spark.sparkContext, threading.Event(), threading.Event(), []

    def work() -> None:
        context.addJobTag(tag)
        context.setInterruptOnCancel(True)
        try:
            value = spark.sql(query, df=df) if isinstance(query, str) else query(df)
            if not late.is_set():
                answers.append(format_result(value))
        except Exception as reason:  # whatever a user's query raises is its answer
            answers.append(Answer(Result(), error=f"{type(reason).__name__}: {reason}"))
        finally:
            ended.set()

    def cancel() -> None:
        while not ended.is_set():
            context.cancelJobsWithTag(tag)
            ended.wait(CANCEL_EVERY_S)

    InheritableThread(target=work, session=spark, daemon=True).start()
    if ended.wait(timeout_s):
        return answers[0]
    late.set()
    threading.Thread(target=cancel, daemon=True).start()
    return Answer(Result(), error=f"TimeoutError: the query took longer than {timeout_s:g} seconds")


def format_result(value: Any) -> Answer:
    """A table, a single value, or nothing, in a form JSON can hold. A 1 x 1 table is a single value."""
    from ..sources.records import json_value, records

    if value is None:
        return Answer(Result())
    if not isinstance(value, DataFrame):
        if isinstance(value, float) and (value != value or abs(value) == float("inf")):
            value = None
        elif not isinstance(value, (bool, int, float, str)):
            value = str(value)
        return Answer(Result("scalar", value))
    if len(value.columns) == 1 and len(cell := value.select(json_value(value, value.columns[0])).take(2)) == 1:
        return format_result(cell[0][0]) if cell[0][0] is not None else Answer(Result("scalar"))
    shown = [json.loads(r["record"]) for r in records(value.limit(MAX_RESULT_ROWS + 1)).collect()]
    cut = len(shown) > MAX_RESULT_ROWS
    # The figure of a result that is shown whole is made of the rows shown; the query does not run again.
    whole = value if cut or not shown else _again(value, shown)
    return Answer(Result("dataframe", None, value.columns, shown[:MAX_RESULT_ROWS], cut), figure=auto_figure(whole) if shown else None)


def _again(result: DataFrame, shown: list[dict]) -> DataFrame:
    """The rows shown as a table of the result's types."""
    spark = result.sparkSession
    if len(result.columns) != 2:
        return result
    rows = spark.createDataFrame([(json.dumps(r),) for r in shown], "record string")
    options = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "dateFormat": "yyyy-MM-dd['T'HH:mm:ss]"}
    return rows.select(F.from_json("record", result.schema, options).alias("r")).select("r.*")


def auto_figure(result: DataFrame) -> dict | None:
    """Chart of a result with exactly one numeric and one other column: a line over dates, else bars; see ``bounded_figure`` for large ones."""
    numeric = [f.name for f in result.schema if isinstance(f.dataType, T.NumericType)]
    if len(result.columns) != 2 or len(numeric) != 1:
        return None
    y = numeric[0]
    x = next(c for c in result.columns if c != y)
    kind = "line" if isinstance(result.schema[x].dataType, TIME_TYPES) else "bar"
    return bounded_figure(result, kind, x, y, "sum", f"{y} by {x}")
