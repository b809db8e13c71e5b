"""Order statistics over sliding ranges of time, without a range's values beside each row.

Each key's rows are cut into stretches as long as the range; a row goes to its own stretch and, as history, to the next one, so a
stretch has all that its rows look back on and a key that holds most of the table is dealt to many tasks. A task reads
stretches in order of time, as Arrow batches, and holds the range once, in two heaps that meet at the median; what
leaves the range is removed when it comes to the top.
"""

from __future__ import annotations

import heapq
from collections import Counter, deque
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class SlidingMedian:
    """The upper median of a multiset under insertion and removal."""

    def __init__(self) -> None:
        self.low: list[float] = []  # negated: the smaller half
        self.high: list[float] = []  # the upper median on top
        self.gone_low: Counter = Counter()
        self.gone_high: Counter = Counter()
        self.n_low = self.n_high = 0

    def __len__(self) -> int:
        return self.n_low + self.n_high

    def add(self, x: float) -> None:
        if self.n_high and x >= self._top_high():
            heapq.heappush(self.high, x)
            self.n_high += 1
        elif not self.n_high:
            heapq.heappush(self.high, x)
            self.n_high += 1
        else:
            heapq.heappush(self.low, -x)
            self.n_low += 1
        self._balance()

    def remove(self, x: float) -> None:
        if x >= self._top_high():
            self.gone_high[x] += 1
            self.n_high -= 1
        else:
            self.gone_low[x] += 1
            self.n_low -= 1
        self._balance()

    def value(self) -> float | None:
        return self._top_high() if self.n_high else None

    def _top_high(self) -> float:
        while self.gone_high and self.gone_high[self.high[0]]:
            x = heapq.heappop(self.high)
            self.gone_high[x] -= 1
            if not self.gone_high[x]:
                del self.gone_high[x]
        return self.high[0]

    def _top_low(self) -> float:
        while self.gone_low and self.gone_low[-self.low[0]]:
            x = -heapq.heappop(self.low)
            self.gone_low[x] -= 1
            if not self.gone_low[x]:
                del self.gone_low[x]
        return -self.low[0]

    def _balance(self) -> None:
        """The upper half is as large as the lower one, or larger by one."""
        while self.n_high > self.n_low + 1:
            heapq.heappush(self.low, -self._top_high())
            heapq.heappop(self.high)
            self.n_low, self.n_high = self.n_low + 1, self.n_high - 1
        while self.n_low > self.n_high:
            heapq.heappush(self.high, self._top_low())
            heapq.heappop(self.low)
            self.n_low, self.n_high = self.n_low - 1, self.n_high + 1


class _Range:
    """The rows of one stretch that the present second looks back on."""

    def __init__(self, length: int):
        self.length, self.median, self.held = length, SlidingMedian(), deque()

    def take(self, second: int, rows: list[tuple[int, float | None]]) -> tuple[float | None, int, int]:
        """Upper median, known values and earliest time, after the rows (time, value) of one second."""
        for at, value in rows:
            self.held.append((second, at, value))
            if value is not None:
                self.median.add(value)
        while self.held[0][0] < second - self.length:
            _, _, value = self.held.popleft()
            if value is not None:
                self.median.remove(value)
        return self.median.value(), len(self.median), self.held[0][1]


def sliding_median(rows: DataFrame, keys: list[str], at: str, value: str, seconds: int) -> DataFrame:
    """Every row with ``usual`` (the upper median), ``n`` and ``oldest_us`` over its key's rows of the last ``seconds``, itself and others of its second too.

    Null values are rows without a value, null keys are one key, rows without a time are left out. Memory: the values of one range and
    the rows of one second.
    """
    schema = rows.schema
    us = F.unix_micros(F.col(at).cast("timestamp"))
    marked = rows.filter(F.col(at).isNotNull()).withColumn("_us", us).withColumn("_sec", F.floor(F.col("_us") / 1_000_000).cast("long")).withColumn("_value", F.col(value).cast("double"))
    stretch = F.floor(F.col("_sec") / max(1, seconds)).cast("long")
    marked = marked.withColumn("_own", stretch).withColumn("_part", F.explode(F.array(stretch, stretch + 1))).withColumn("_own", F.col("_own") == F.col("_part"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = marked.repartition(n, *keys, "_part").sortWithinPartitions(*keys, "_part", "_us", "_value")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state, carry = None, _Range(seconds), None
        for b in chain(batches, [None]):
            parts = [x for x in (carry, b) if x is not None]
            if not parts:
                return
            t = parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            runs = list(zip(*(t.column(c).to_pylist() for c in [*keys, "_part", "_sec"]), strict=True))
            times, values = t.column("_us").to_pylist(), t.column("_value").to_pylist()
            starts = [i for i, r in enumerate(runs) if not i or r != runs[i - 1]]
            # the last second may go on in the next batch
            ends = [*starts[1:], *([len(runs)] if b is None and runs else [])]
            found: list[tuple] = []
            for lo, hi in zip(starts, ends, strict=False):
                if runs[lo][:-1] != group:
                    group, state = runs[lo][:-1], _Range(seconds)
                found += [state.take(runs[lo][-1], list(zip(times[lo:hi], values[lo:hi], strict=True)))] * (hi - lo)
            done, carry = t.slice(0, len(found)), t.slice(len(found))
            if found:
                made = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.float64(), pa.int64(), pa.int64()))]
                full = pa.RecordBatch.from_arrays([*(done.column(c) for c in names), *made, done.column("_own")], [*names, "usual", "n", "oldest_us", "_own"])
                yield full.filter(done.column("_own")).select([*names, "usual", "n", "oldest_us"])

    out = StructType(list(schema.fields)).add("usual", "double").add("n", "long").add("oldest_us", "long")
    return dealt.mapInArrow(run, out)
