"""TRANSFORM, MAP and REDUCE: rows through a program or a Python function, in Arrow batches."""

from __future__ import annotations

import itertools
import re
import subprocess
import threading
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

# How a value's own separators are written between a program and us.
_ESCAPES = {"\\": "\\\\", "\t": "\\t", "\n": "\\n", "\r": "\\r"}
_PLAIN = {v: k for k, v in _ESCAPES.items()}


def _line(row: tuple) -> str:
    text = lambda v: str(v).lower() if isinstance(v, bool) else re.sub(r"[\\\t\n\r]", lambda m: _ESCAPES[m[0]], str(v))
    return "\t".join("\\N" if v is None else text(v) for v in row) + "\n"


def _values(line: str, n: int) -> list[str | None]:
    out = [None if v == "\\N" else re.sub(r"\\[\\tnr]", lambda m: _PLAIN[m[0]], v) for v in line.split("\t")]
    return (out + [None] * n)[:n]


def transform(df: DataFrame, columns: list[str], command: str, schema: str, rows: int = 10_000) -> DataFrame:
    """``SELECT TRANSFORM (columns) USING 'command' AS (...)``: tab-separated lines in and out, \\N for null.

    One process for each task, fed and read at once. Backslashes, tabs and line ends inside values are written \\\\, \\t, \\n and \\r. A
    program that ends with an error fails the task.
    """
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = subprocess.Popen(["sh", "-c", command], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        failed = []

        def feed() -> None:
            try:
                with made.stdin as out:
                    for b in batches:
                        out.writelines(_line(r).encode() for r in zip(*(c.to_pylist() for c in b.columns)))
            except BrokenPipeError:  # the program has read enough
                pass
            except Exception as e:  # told below, in the task's own thread
                failed.append(e)

        writer = threading.Thread(target=feed, daemon=True)
        writer.start()
        try:
            while some := list(itertools.islice(made.stdout, rows)):
                cols = zip(*(_values(x.decode().removesuffix("\n"), len(names)) for x in some))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names)
            writer.join()
            if made.wait():
                raise RuntimeError(f"{command!r} ended with {made.returncode}")
            if failed:
                raise failed[0]
        finally:
            if made.poll() is None:
                made.kill()

    return df.select(*columns).mapInArrow(run, ", ".join(f"{n} string" for n in names))


def map_rows(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``MAP ... USING``: each batch of rows by itself."""
    return df.mapInPandas(lambda it: (f(b) for b in it), schema)


def reduce_rows(df: DataFrame, keys: list[str], f: Callable[[tuple, Iterator[pd.DataFrame]], pd.DataFrame], schema: str) -> DataFrame:
    """``REDUCE ... USING`` after DISTRIBUTE BY and SORT BY keys: f(key, frames) for each key, all of whose rows come, in several frames.

    A key goes on over Arrow batches and is never put together in memory; what ``f`` leaves unread is skipped. Nulls are a key.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, pd.DataFrame]]:
        for b in batches:
            if len(b):
                new = (b[keys] != b[keys].shift()) & ~(b[keys].isna() & b[keys].shift().isna())
                for _, part in b.groupby(new.any(axis=1).cumsum(), sort=False):
                    yield tuple(None if pd.isna(v) else v for v in part[keys].iloc[0]), part

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, some in itertools.groupby(pieces(batches), key=lambda x: x[0]):
            yield f(key, (part for _, part in some))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)
