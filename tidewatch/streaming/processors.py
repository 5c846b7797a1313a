"""Keyed state for streams: rules that look at a key's recent past, one micro-batch after the other.

Rows of a micro-batch are taken in the order of time and id. Each state is bounded: recent rows within a
window, or a few numbers. In streams that run on, the state of a key that falls silent ends after a time to
live; a table has no state that outlives it.
"""

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.detect import FAILED, RecentScan

SECOND = 1_000_000
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(["us", "event_id"], ignore_index=True)


class Keyed(StatefulProcessor):
    """A processor whose state has a time to live, set where it is used in a stream."""

    ttl_ms: int | None = None

    def close(self) -> None:
        pass


class TokenBucket(Keyed):
    """allowed for each alert of a source: whether its bucket has a token left."""

    OUTPUT = "source_ip string, event_id bigint, allowed boolean"

    def __init__(self, capacity: float = 10.0, refill: float = 5.0):
        self.capacity, self.refill = capacity, refill

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "last bigint, tokens double", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, tokens = self.state.get() if self.state.exists() else (None, self.capacity)
        df, allowed = _in_order(rows), []
        for us in df.us:
            passed = max(0.0, (us - last) / SECOND) if last is not None else 0.0
            tokens = min(self.capacity, tokens + passed * self.refill)
            ok = tokens >= 1.0
            tokens -= ok
            allowed.append(ok)
            last = int(us)
        self.state.update((last, float(tokens)))
        yield pd.DataFrame({"source_ip": key[0], "event_id": df.event_id, "allowed": allowed})


class Cooldown(Keyed):
    """Candidates of a key that are at least `seconds` after the last one kept."""

    OUTPUT = "key string, us bigint, event_id bigint"

    def __init__(self, seconds: float):
        self.gap = int(seconds * SECOND)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "us bigint", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.state.get()[0] if self.state.exists() else None
        kept = []
        for r in _in_order(rows).itertuples():
            if last is None or r.us - last >= self.gap:
                last = int(r.us)
                kept.append((key[0], last, int(r.event_id)))
        if last is not None:
            self.state.update((last,))
        yield pd.DataFrame(kept, columns=["key", "us", "event_id"])


class ScanCounts(Keyed):
    """Different ports, hosts and endpoints, and the share of failed connections, of a source's last seconds at each of its connections."""

    OUTPUT = "src_ip string, event_id bigint, us bigint, ports bigint, hosts bigint, endpoints bigint, failed bigint, failure_ratio double"
    def __init__(self, seconds: int = 10):
        self.span = seconds * SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "us bigint, dst_ip string, dst_port int, bad boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        past = [tuple(x) for x in self.recent.get()] if self.recent.exists() else []
        out, counts = [], RecentScan(self.span)
        as_rows = lambda rows: [(port, host, "S0" if bad else "SF") for _, host, port, bad in rows]
        for us, earlier in groupby(past, key=lambda x: x[0]):
            counts(us, as_rows(earlier))
        df = _in_order(rows)
        own = [(int(r.us), r.dst_ip, int(r.dst_port), r.conn_state in FAILED) for r in df.itertuples()]
        # Rows of the same time count together, as in a RANGE frame.
        for us, group in groupby(zip(own, df.event_id, strict=True), key=lambda x: x[0][0]):
            group = list(group)
            *seen, share = counts(us, as_rows(r for r, _ in group))
            out += [(key[0], int(event), us, *seen, round(share, 4)) for _, event in group]
        if own:
            kept = [x for x in (*past, *own) if x[0] >= own[-1][0] - self.span]
            self.recent.put(kept)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in self.OUTPUT.split(", ")])


class Beacons(Keyed):
    """The last gaps of a pair's connections: count, mean and coefficient of variation at each new gap."""

    OUTPUT = "pair string, event_id bigint, n_gaps int, mean double, cv double"

    def __init__(self, rows: int = 25):
        self.rows = rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("gaps", "last bigint, gaps array<double>", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, gaps = self.state.get() if self.state.exists() else (None, [])
        gaps, out = list(gaps or []), []
        for r in _in_order(rows).itertuples():
            if last is not None and r.us > last:
                gaps = [*gaps, (r.us - last) / SECOND][-self.rows :]
                s = pd.Series(gaps)
                thin = len(gaps) < 2 or s.mean() <= 1e-6
                out.append((key[0], int(r.event_id), len(gaps), 0.0 if thin else round(s.mean(), 4), 1.0 if thin else round(s.std() / s.mean(), 4)))
            last = int(r.us) if last is None else max(last, int(r.us))
        self.state.update((last, gaps))
        yield pd.DataFrame(out, columns=["pair", "event_id", "n_gaps", "mean", "cv"])


def keyed(df: DataFrame, key: str, processor: Keyed, ttl: int | None = None) -> DataFrame:
    """df, a stream or a table, through a processor by key.

    In a stream that runs on, a key's state ends `ttl` seconds after its last change. Such a stream
    always has another batch to run, so one that is to end with its input takes no `ttl`.
    """
    df.sparkSession.conf.set(*STATE_STORE)
    _ = df.sparkSession.streams.active  # a table's state store, too, needs the coordinator that comes with the streams
    ends = ttl is not None and df.isStreaming
    processor.ttl_ms = ttl * 1000 if ends else None
    return df.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.OUTPUT, outputMode="append", timeMode="processingTime" if ends else "none")
