"""The frontier as a stateful stream: URLs, queue and budgets of each host are state, claims are what comes out.

Events come in as rows of EVENT: `found` (a URL with depth, priority, where it was found, seq) and `result` (a URL with its end, done,
failed or skipped, and the documents it gave). The state of a host is kept with the stream's checkpoint, so a batch that is replayed
after a crash finds the state from before it, and a URL that was claimed without a result is claimed again when its lease ends.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lettera.operators import urls as U

EVENT = "event string, url string, depth int, priority int, discovered_from string, seq long, result string, documents int"
CLAIM = "host string, url string, depth int, state string, attempts int, discovered_from string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
URL = "state string, depth int, priority int, discovered_from string, seq long, attempts int"
#: What is queued for the next claims, in waves, so that the whole of a host's pending URLs is looked through only once in so many.
AHEAD = 32


@dataclass(frozen=True)
class Limits:
    """Of each host: URLs that are claimed and have no result at once, milliseconds between claims, milliseconds until a claim without a result is made again, depth, and budgets (0: none) of successes, documents and milliseconds."""

    wave: int = 4
    delay: int = 1000
    lease: int = 600_000
    max_depth: int = 12
    max_urls: int = 0
    max_documents: int = 0
    time_budget: int = 0


class Frontier(StatefulProcessor):
    """One host's frontier. Of a URL that is found again the first finding counts; a result for a URL that is not active changes nothing."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.urls = handle.getMapState("urls", "url string", URL)
        self.pending = handle.getMapState("pending", "url string", "priority int, depth int, seq long")
        self.active = handle.getMapState("active", "url string", "until long")
        self.host = handle.getValueState("host", "fetched long, documents long, began long, next long, ready array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        fetched, documents, began, due, ready = self.host.get() if self.host.exists() else (0, 0, now, 0, [])
        ready, out = list(ready), []
        worst = self.order(ready[-1]) if ready else None
        # findings first, in their order: a result can be in the same batch
        for r in sorted(rows, key=lambda r: (r.event != "found", r.seq or 0)):
            if r.event == "found":
                if self.urls.containsKey((r.url,)):
                    continue
                deep = r.depth > self.limits.max_depth
                self.urls.updateValue((r.url,), ("skipped" if deep else "pending", r.depth, r.priority, r.discovered_from, r.seq, 0))
                if deep:
                    out.append(self.row(key, r.url, "skipped"))
                    continue
                self.pending.updateValue((r.url,), (r.priority, r.depth, r.seq))
                if worst and self.order(r.url) < worst:
                    ready, worst = [], None  # it comes before some that are queued
            elif self.active.containsKey((r.url,)):
                self.active.removeKey((r.url,))
                self.change(r.url, r.result)
                fetched, documents = fetched + (r.result == "done"), documents + (r.documents or 0)
        yield from out
        yield from self.claims(key, now, fetched, documents, began, due, ready)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        fetched, documents, began, due, ready = self.host.get()
        yield from self.claims(key, now, fetched, documents, began, due, list(ready))

    def close(self) -> None:
        pass

    def order(self, url: str):
        p = self.pending.getValue((url,))
        return (-p[0], p[1], p[2]) if p else (1 << 31, 0, 0)

    def change(self, url: str, state: str, tries: int = 0) -> None:
        old = self.urls.getValue((url,))
        self.urls.updateValue((url,), (state, *old[1:5], old[5] + tries))

    def row(self, key, url: str, state: str) -> Row:
        u = self.urls.getValue((url,))
        return Row(host=key[0], url=url, depth=u[1], state=state, attempts=u[5], discovered_from=u[3])

    def claims(self, key, now, fetched, documents, began, due, ready) -> Iterator[Row]:
        """The next wave, unless it is too early or a budget is used up; sets the timer for the one after."""
        limits, out = self.limits, []
        for (url,), (until,) in list(self.active.iterator()):
            if until <= now:
                self.active.removeKey((url,))
                self.change(url, "pending")
                u = self.urls.getValue((url,))
                self.pending.updateValue((url,), (u[2], u[1], u[4]))
                ready = []
        out_of = limits.max_urls and fetched >= limits.max_urls or limits.max_documents and documents >= limits.max_documents or limits.time_budget and now - began > limits.time_budget
        room = min(limits.wave, limits.max_urls - fetched) if limits.max_urls else limits.wave
        room -= sum(1 for _ in self.active.keys())
        if not out_of and due <= now and room > 0:
            ready = [u for u in ready if self.pending.containsKey((u,))]
            if len(ready) < room:
                best = heapq.nsmallest(AHEAD * limits.wave, self.pending.iterator(), key=lambda p: (-p[1][0], p[1][1], p[1][2]))
                ready = [k[0] for k, _ in best]
            for url in ready[:room]:
                self.pending.removeKey((url,))
                self.change(url, "active", 1)
                self.active.updateValue((url,), (now + limits.lease,))
                out.append(self.row(key, url, "active"))
            ready = ready[room:]
            due = now + limits.delay if out else due
        self.host.update((fetched, documents, began, due, ready))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        leases = [until for _, (until,) in self.active.iterator()]
        wakes = leases + ([max(due, now + 1)] if not out_of and next(self.pending.keys(), None) else [])
        if wakes and not out_of:
            self.handle.registerTimer(max(min(wakes), now + 1))
        yield from out


def claims(events: DataFrame, limits: Limits = Limits(), shards: int = 1, hosts: list[str] | None = None, deny: list[str] | None = None) -> DataFrame:
    """CLAIM rows of a stream of EVENT rows: URLs to fetch (active) and those too deep (skipped).

    URLs are brought to their normal form; with hosts, those out of scope are left out. A host with so many URLs
    that one task cannot hold them is split into `shards` by the URL's hash, each with an equal share of the
    limits: a URL stays in its shard, so that it is claimed once, and the order of claims holds within a shard.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    named = events.withColumn("url", U.normalize_url(F.col("url"))).where("url <> ''")
    named = named.where(U.in_scope(F.col("url"), hosts, deny or [])) if hosts else named
    keyed = named.withColumn("host", U.host(F.col("url"))).withColumn("shard", F.pmod(F.xxhash64("url"), F.lit(shards)).cast("int"))
    part = lambda n: -(-n // shards)
    own = Limits(part(limits.wave), limits.delay, limits.lease, limits.max_depth, part(limits.max_urls), part(limits.max_documents), limits.time_budget)
    return keyed.groupBy("host", "shard").transformWithState(statefulProcessor=Frontier(own), outputStructType=CLAIM, outputMode="append", timeMode="processingTime")


def start(spark: SparkSession, events_dir: str, claims_dir: str, checkpoint: str, limits: Limits = Limits(), **scope):
    """The stream over JSON files of events, to Parquet files of claims, each written once. It runs until it is stopped, as timers go on without events."""
    events = spark.readStream.schema(EVENT).json(events_dir)
    return claims(events, limits, **scope).writeStream.format("parquet").option("path", claims_dir).option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()


def host_rates(events: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Fetches a host and window of event time; late rows count until the watermark passes."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "host").agg(F.count("*").alias("n"))
