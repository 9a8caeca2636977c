"""Structured Streaming: trades to bars, news to running aggregates, and idempotent sinks.

A stream of trades has event_id, symbol, price, volume, ts (timestamp), seq. The default path uses Spark's watermark,
which is one for the query; per_symbol_bars keeps one for each symbol, as the reference semantics have it.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LATENESS = "5 seconds"
HORIZON = "15 minutes"


def unique(trades: DataFrame, horizon: str = HORIZON) -> DataFrame:
    """Drops event ids seen within the horizon of event time."""
    return trades.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["event_id"])


def minute_bars(trades: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Final one-minute bars, for append mode; late trades are left out (Spark counts them in its progress)."""
    first, last = F.struct("ts", "seq"), F.struct("ts", -F.col("seq"))
    rows = trades.withWatermark("ts", lateness).groupBy(F.window("ts", "1 minute"), "symbol")
    return rows.agg(
        F.min_by("price", first).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", last).alias("close"),
        F.sum("volume").alias("volume"), F.count("*").alias("trade_count"),
    )


def five_minute_bars(minutes: DataFrame) -> DataFrame:
    """Five-minute bars of the final minute bars: a second stateful step on their window's time."""
    at = F.window_time("window")
    rows = minutes.withColumn("at", at).withColumn("minute", F.col("window.start"))
    out = rows.groupBy(F.window("at", "5 minutes"), "symbol").agg(
        F.min_by("open", "minute").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "minute").alias("close"),
        F.sum("volume").alias("volume"), F.sum("trade_count").alias("trade_count"),
    )
    return out


class SymbolBars(StatefulProcessor):
    """Bars of one symbol with its own watermark: open bars and the latest event time are the state.

    Emits bars whose end the watermark has reached, and late trades with their reason. State is bounded by the
    lateness: a bar leaves it when it is final. Rows of a batch are taken in order of seq.
    """

    def __init__(self, width_ms: int = 60_000, lateness_ms: int = 5_000):
        self.width, self.lateness = width_ms, lateness_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "newest long, done long")
        self.bars = handle.getMapState("bars", "start long", "open double, high double, low double, close double, volume double, n long, first long, last long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        out = []
        newest, done = self.mark.get() if self.mark.exists() else (-(1 << 60), -(1 << 60))
        held = {k[0]: tuple(v) for k, v in self.bars.iterator()}
        before = set(held)
        batch = pd.concat(list(rows)).sort_values("seq")
        for ts, price, volume, event_id in zip(batch["ts_ms"], batch["price"], batch["volume"], batch["event_id"], strict=True):
            start = int(ts) // self.width * self.width
            end = start + self.width
            if newest - self.lateness >= end:
                reason = "bar already finalized" if end <= done else "lateness exceeded configured threshold"
                out.append(("late", key[0], start, price, price, price, price, volume, 1, int(event_id), reason))
            else:
                o, h, low, c, v, n, a, b = held.get(start, (price, price, price, price, 0.0, 0, int(ts), int(ts)))
                held[start] = (price if ts < a else o, max(h, price), min(low, price), price if ts > b else c, v + volume, n + 1, min(a, int(ts)), max(b, int(ts)))
                newest = max(newest, int(ts))
        for start in sorted(s for s in held if s + self.width <= newest - self.lateness):
            o, h, low, c, v, n, _, _ = held.pop(start)
            done = max(done, start + self.width)
            out.append(("bar", key[0], start, o, h, low, c, v, n, None, None))
        for start in before - set(held):
            self.bars.removeKey((start,))
        for start, bar in held.items():
            self.bars.updateValue((start,), bar)
        self.mark.update((newest, done))
        yield pd.DataFrame(out, columns=["kind", "symbol", "start_ms", "open", "high", "low", "close", "volume", "n", "event_id", "reason"]).astype({"n": "int64", "event_id": "Int64"})

    def close(self) -> None:
        pass


def per_symbol_bars(trades: DataFrame, width_ms: int = 60_000, lateness_ms: int = 5_000) -> DataFrame:
    """Rows of kind bar or late from SymbolBars; needs the RocksDB state store."""
    rows = trades.select("symbol", F.unix_millis("ts").alias("ts_ms"), "price", "volume", "seq", "event_id")
    schema = "kind string, symbol string, start_ms long, open double, high double, low double, close double, volume double, n long, event_id long, reason string"
    return rows.groupBy("symbol").transformWithStateInPandas(SymbolBars(width_ms, lateness_ms), schema, "Append", "None")


class Aligner(StatefulProcessor):
    """Holds the bars of one end until all symbols are there, or until `wait_ms` of processing time has passed."""

    def __init__(self, symbols: list[str], wait_ms: int = 10_000):
        self.symbols, self.wait = set(symbols), wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.have = handle.getMapState("have", "symbol string", "close double")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        fresh = not self.have.exists()
        for pdf in rows:
            for symbol, close in zip(pdf["symbol"], pdf["close"], strict=True):
                self.have.updateValue((symbol,), (close,))
        have = {k[0] for k in self.have.keys()}
        if have >= self.symbols:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.have.clear()
            yield pd.DataFrame({"bar_end_ms": [key[0]], "complete": [True], "missing": [""]})
        elif fresh:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        missing = ",".join(sorted(self.symbols - {k[0] for k in self.have.keys()}))
        self.have.clear()
        yield pd.DataFrame({"bar_end_ms": [key[0]], "complete": [False], "missing": [missing]})

    def close(self) -> None:
        pass


def align(found: DataFrame, symbols: list[str], wait_ms: int = 10_000) -> DataFrame:
    rows = found.select("bar_end_ms", "symbol", "close")
    return rows.groupBy("bar_end_ms").transformWithStateInPandas(Aligner(symbols, wait_ms), "bar_end_ms long, complete boolean, missing string", "Append", "ProcessingTime")


def running_news(articles: DataFrame) -> DataFrame:
    """Aggregates of each sector and day, for update mode: written again with each new article. Deliveries of one id count once."""
    once = articles.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["article_id"])
    return once.groupBy("sector", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))


def into(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append", once: bool = True):
    """Starts a query that hands each batch to an idempotent writer; with `once`, it ends with what is there."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (w.trigger(availableNow=True) if once else w).start()


def insert_batches(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch writer: first write of a key wins; a batch that comes again adds nothing."""
    from tidewright.sources.writers import insert_new

    return lambda batch, _: insert_new(batch, path, keys, [F.asc(c) for c in order])


def kafka(rows: DataFrame, servers: str, topic: str, checkpoint: str, key: str = "symbol"):
    """JSON messages keyed by symbol; needs Spark's Kafka package."""
    out = rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.enable.idempotence": "true", "kafka.compression.type": "zstd", "checkpointLocation": checkpoint}
    return out.writeStream.format("kafka").options(**options).start()
