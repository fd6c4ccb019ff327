"""Ordered groups through a pure function, many groups to a batch."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_groups(df: DataFrame, key: str, order: list[str], function: Callable[[list], list[tuple]], schema: str) -> DataFrame:
    """function(rows of one key, in order) gives the result's rows for that key.

    Rows are dealt and sorted by key once and stream by; only one key's rows are held at a time, and there is no call between the JVM and
    Python for each group. Rows are named tuples. They are dealt by a hash of the key: where df is dealt by the key itself, as joins,
    windows and unions of such tables leave it, Spark drops a second deal by it and may then still regroup each side on its own.
    """
    names = df.columns
    at = names.index(key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row_of = namedtuple("row_of", names)  # noqa: PYI024
        columns = [c.split()[0] for c in schema.split(", ")]
        held: list = []
        for batch in batches:
            rows = [row_of(*r) for r in zip(*[batch[c].tolist() for c in names], strict=True)]
            out: list[tuple] = []
            for _, own in groupby(rows, key=itemgetter(at)):
                own = list(own)
                if held and held[0][at] != own[0][at]:
                    out += function(held)
                    held = []
                held += own
            yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame(function(held), columns=columns)

    return df.repartition(F.xxhash64(key)).sortWithinPartitions(key, *order).mapInPandas(run, schema)
