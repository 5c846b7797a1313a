"""Ordered scans: state per key, carried from row to row in order, where what is decided depends on what was decided before.

Rows are dealt by key and sorted inside partitions, so a task streams Arrow batches and holds the state of
one key at a time: neither a key's rows nor arrays of them are gathered, however many they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def scan(df: DataFrame, key: list[str], order: list[str], needs: list[str], made: str, new_state: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """df with the columns `made` (as DDL) that a key's state gives for each row; it gets the columns `needs`.

    new_state() makes the state of a new key. Rows with null keys are one key.
    """
    added = StructType.fromDDL(made)
    schema = StructType([*df.schema.fields, *added.fields])
    sent = df.repartition(*key).sortWithinPartitions(*key, *order)
    at_key, at_needs = [df.columns.index(c) for c in key], [df.columns.index(c) for c in needs]
    types = [to_arrow_type(f.dataType) for f in added.fields]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for b in batches:
            if not b.num_rows:
                continue
            keys = zip(*(b.column(i).to_pylist() for i in at_key), strict=True)
            rows = zip(*(b.column(i).to_pylist() for i in at_needs), strict=True)
            out = []
            for k, row in zip(keys, rows, strict=True):
                if k != last:
                    last, state = k, new_state()
                out.append(state(*row))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=names)

    return sent.mapInArrow(run, schema)


def kept(df: DataFrame, key: list[str], order: list[str], needs: list[str], new_state: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """The rows for which a key's state says yes: new_state() gives a function that returns (bool,)."""
    flag = "_kept"
    while flag in df.columns:
        flag = "_" + flag
    return scan(df, key, order, needs, f"`{flag}` boolean", new_state).where(f"`{flag}`").drop(flag)


def scan_peers(df: DataFrame, key: list[str], at: str, needs: list[str], made: str, new_state: Callable[[], Callable[[int, list], tuple]]) -> DataFrame:
    """As scan, for rows of one key and time together, as a RANGE frame counts them: the state gets (time, rows) and gives what all of them get.

    Windows of time then cost what comes and goes at a row, not all that they hold.
    """
    added = StructType.fromDDL(made)
    schema = StructType([*df.schema.fields, *added.fields])
    sent = df.repartition(*key).sortWithinPartitions(*key, at)
    places = [df.columns.index(c) for c in (*key, at, *needs)]
    types = [to_arrow_type(f.dataType) for f in added.fields]
    names, width = schema.names, len(key) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        held: list[pa.RecordBatch] = []  #: the rows of the last key and time so far, which may go on in the next batch

        def groups(table: pa.Table, whole: bool) -> tuple[int, list]:
            nonlocal last, state
            rows = list(zip(*(table.column(i).to_pylist() for i in places), strict=True))
            out: list = []
            begin = 0
            for i in range(1, len(rows) + 1):
                if i == len(rows) and not whole:
                    break
                if i == len(rows) or rows[i][:width] != rows[begin][:width]:
                    k = rows[begin][: width - 1]
                    if k != last:
                        last, state = k, new_state()
                    out += [state(rows[begin][width - 1], [r[width:] for r in rows[begin:i]])] * (i - begin)
                    begin = i
            return begin, out

        def finished(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            table = pa.Table.from_batches(held)
            n, out = groups(table, whole)
            if n:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                done = table.slice(0, n).combine_chunks()
                yield pa.RecordBatch.from_arrays([*(c.chunk(0) for c in done.columns), *columns], names=names)
            held = table.slice(n).combine_chunks().to_batches()

        for b in batches:
            if b.num_rows:
                held.append(b)
                yield from finished(False)
        if held:
            yield from finished(True)

    return sent.mapInArrow(run, schema)
