"""Rows of remote tools: a client that is given calls a tool for each distinct set of arguments."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Client = Callable[[str, dict], list[dict]]


class StubServer:
    """An offline server with one tool: pair gives two rows for a number k."""

    def __call__(self, tool: str, arguments: dict) -> list[dict]:
        if tool != "pair":
            raise ValueError(f"no tool named {tool}")
        return [{"k": arguments["k"], "twice": 2 * arguments["k"] + i} for i in range(2)]


def rows(calls: DataFrame, arguments: str, client: Client, tool: str) -> DataFrame:
    """(arguments, row): for each distinct JSON object of arguments, the rows that a tool gives, as JSON.

    An error of the client fails the query.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(a, json.dumps(r)) for a in b["arguments"] for r in client(tool, json.loads(a))]
            yield pd.DataFrame(got, columns=["arguments", "row"])

    distinct = calls.select(F.col(arguments).alias("arguments")).filter("arguments is not null").distinct()
    return distinct.mapInPandas(run, "arguments string, row string")
