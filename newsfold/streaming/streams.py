"""Streaming forms. Each takes streaming frames and gives streaming frames; the batch twins are in ``operators``."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import likeness as L
from ..functions import values as V
from ..operators.feedback import BASELINE_HOURS, GRACE_SECONDS
from ..operators.memory import CLAIM_RATIO, MOST_CLAIMS, NUMBERS, TEXT_RATIO, TEXTS
from ..scale import settle
from ..sources.tables import lookback  # noqa: F401  (stream and batch look back alike)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_DAYS = 7
#: Keys that the collector remembers. A fixed value.
SEEN = 8_000


def with_lateness(df: DataFrame, at: str, delay: str) -> DataFrame:
    return df.withWatermark(at, delay)


def dedup_stream(df: DataFrame, keys: list[str], at: str = "fetched_at", horizon: str = "1 day") -> DataFrame:
    """First row of each (key, content) within a bounded memory of time."""
    return df.withWatermark(at, horizon).dropDuplicatesWithinWatermark(keys)


def run_stream(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = 300) -> StreamingQuery:
    """A pass for every micro-batch; ``seconds`` None works off what is there and ends."""
    writer = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{max(30, seconds)} seconds")).start()


def run_pipeline_stream(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = 300) -> StreamingQuery:
    return run_stream(df, each, checkpoint, seconds)


def run_feedback_stream(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = 120) -> StreamingQuery:
    return run_stream(df, each, checkpoint, seconds)


def horizon_stream(predictions: DataFrame, prices: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """``(asset, id, kind, offset, price, pct)`` of streaming forecasts ``(id, asset, created_at, horizon_minutes)`` and prices ``(asset, at, seq, price)``.

    A sample of each horizon is taken by an event-time timer, half a minute after the horizon has passed: the last price at or before it
    against the last one at or before the forecast, as the batch form does it. The baseline is closed likewise; a forecast that has
    none ``BASELINE_HOURS`` after its creation is told as ``abandoned``. Prices may come out of order within ``delay``; what comes later is
    never used. Timers fire when the watermark passes them; the state of an asset keeps what its open forecasts may still ask for.
    """
    horizons = F.array_distinct(F.array_append(F.array(*map(F.lit, V.HORIZONS)), F.col("horizon_minutes").cast("int")))
    asked = predictions.select("asset", F.col("created_at").alias("at"), F.lit("forecast").alias("kind"), F.col("id").cast("long").alias("number"), F.lit(None).cast("double").alias("price"), horizons.alias("offsets"))
    told = prices.select("asset", "at", F.lit("price").alias("kind"), F.col("seq").cast("long").alias("number"), F.col("price").cast("double").alias("price"), F.lit(None).cast("array<int>").alias("offsets"))
    rows = asked.unionByName(told).withWatermark("at", delay).withColumn("micros", F.unix_micros(F.col("at").cast("timestamp")))
    return rows.groupBy("asset").transformWithStateInPandas(HorizonTimers(), "asset string, id long, kind string, offset int, price double, pct double", "Append", "EventTime")


class HorizonTimers(StatefulProcessor):
    """Open forecasts of an asset, the prices that they may ask for, and a timer for every time that something is due."""

    MINUTE, GRACE, DEADLINE = 60_000_000, GRACE_SECONDS * 1_000_000, BASELINE_HOURS * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.prices = handle.getMapState("prices", "at long, seq long", "price double")
        self.open = handle.getMapState("open", "id long", "created long, left array<int>")

    def _due(self, created: int, offset: int) -> int:
        return created + offset * self.MINUTE + self.GRACE

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for kind, number, micros, price, offsets in batch[["kind", "number", "micros", "price", "offsets"]].itertuples(index=False):
                if kind == "price":
                    self.prices.updateValue((int(micros), int(number)), (float(price),))
                else:
                    left = sorted({int(o) for o in offsets if o > 0})
                    self.open.updateValue((int(number),), (int(micros), left))
                    for when in [*(self._due(int(micros), o) for o in left), int(micros) + self.DEADLINE + self.GRACE]:
                        self._wake(when)
        yield pd.DataFrame(columns=["asset", "id", "kind", "offset", "price", "pct"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        times, values = [], []
        for at, price in sorted((k, v[0]) for k, v in self.prices.iterator()):
            times.append(at)
            values.append(price)

        def asof(micros: int) -> float | None:
            place = bisect_right(times, (micros, 1 << 62))
            return values[place - 1] if place else None

        out, oldest = [], now
        for (number,), (created, left) in list(self.open.iterator()):
            base = asof(created)
            due = [o for o in left if self._due(created, o) <= now]
            if due and base is not None and base > 0:
                for o in due:
                    price = asof(created + o * self.MINUTE)
                    out.append((key[0], number, "sample", o, price, (price - base) / base * 100))
            left = [o for o in left if o not in due] if base is not None and base > 0 else list(left)
            late = now >= created + self.DEADLINE + self.GRACE
            if late and not (base is not None and base > 0):
                out.append((key[0], number, "abandoned", None, None, None))
                left = []
            if left:
                self.open.updateValue((number,), (created, left))
                oldest = min(oldest, created)
            else:
                self.open.removeKey((number,))
        # of the prices before the oldest open forecast only the last can be asked for
        for at in times[: max(0, bisect_right(times, (oldest, 1 << 62)) - 1)]:
            self.prices.removeKey(at)
        yield pd.DataFrame(out, columns=["asset", "id", "kind", "offset", "price", "pct"]).astype({"offset": "Int32", "price": "float64", "pct": "float64"})

    def close(self) -> None:
        pass


#: What an event's state holds besides its claims, and the columns that tell how an article changed it.
STATE = [*[f"{n} double" for n in NUMBERS], *[f"{t} string" for t in TEXTS], "status string", "rank int", "articles int", "updates int"]
TOLD = ["event_key", "id", "decision", "changed", "new_claims", "article_count", "update_count", *NUMBERS, *TEXTS, "status", "key_claims"]


class EventState(StatefulProcessor):
    """The state of one event, as a value of its fields and a list of its claims. A row in, its decision and the state after it out."""

    def __init__(self, ttl: int | None) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("event", ", ".join(STATE), ttlDurationMs=self.ttl)
        self.claims = handle.getListState("claims", "claim string", ttlDurationMs=self.ttl)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        """A row of the batch form's events: fields, ``status_rank``, counts and ``key_claims``."""
        row = initialState.iloc[0]
        numbers = [None if pd.isna(row[n]) else float(row[n]) for n in NUMBERS]
        texts = [None if not isinstance(row[t], str) or not row[t] else row[t] for t in (*TEXTS, "status")]
        self.state.update((*numbers, *texts, int(row["status_rank"]), int(row["article_count"]), int(row["update_count"])))
        claims = [] if row["key_claims"] is None else list(row["key_claims"])
        if claims:
            self.claims.put([(c,) for c in claims])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = list(self.state.get()) if self.state.exists() else [None] * (len(NUMBERS) + len(TEXTS) + 2) + [0, 0]
        fields = dict(zip((*NUMBERS, *TEXTS, "status", "rank", "articles", "updates"), held))
        known = [c[0] for c in self.claims.get()] if self.claims.exists() else []
        before, out = len(known), []
        for row in pd.concat(list(rows)).sort_values(["at", "id"]).to_dict("records"):
            first, changed = not fields["articles"], []
            for n in NUMBERS:
                old, new = fields[n], None if pd.isna(row[n]) else float(row[n])
                if (old is None) != (new is None) or (old is not None and old != new and abs(new - old) / max(abs(new), abs(old)) > V.NUMERIC_TOLERANCE):
                    changed.append(n)
                fields[n] = old if new is None else new
            if row["status"]:
                if fields["rank"] != row["status_rank"]:
                    changed.append("status")
                if fields["status"] is None or row["status_rank"] >= (fields["rank"] or 0):
                    fields["status"] = row["status"]
            fields["rank"] = max(fields["rank"] or 0, int(row["status_rank"]))
            for t in TEXTS:
                old, new = fields[t], row[t]
                if new:
                    if old is None or (old != new and L.plain_ratio(old, new) < TEXT_RATIO):
                        changed.append(t)
                    fields[t] = new
            fresh = 0
            for claim in [] if row["claims"] is None else row["claims"]:
                if claim and all(L.plain_ratio(claim, k) < CLAIM_RATIO for k in known):
                    fresh += 1
                    if len(known) < MOST_CLAIMS:
                        known.append(claim)
            changed = [] if first else changed
            decision = "NEW" if first else "UPDATE" if changed or fresh >= 2 else "DUPLICATE"
            fields["articles"], fields["updates"] = fields["articles"] + 1, fields["updates"] + (decision == "UPDATE")
            out.append((key[0], int(row["id"]), decision, ",".join(changed), fresh, fields["articles"], fields["updates"], *[fields[n] for n in (*NUMBERS, *TEXTS, "status")], list(known)))
        self.state.update(tuple(fields.values()))
        if len(known) > before:
            self.claims.put([(c,) for c in known])
        told = pd.DataFrame(out, columns=TOLD)
        yield told.astype({n: "float64" for n in NUMBERS})

    def close(self) -> None:
        pass


def _lasting(days: int | None) -> tuple[int | None, str]:
    """Milliseconds that state lives, and the time mode that this needs. A stream with expiry goes on until it is stopped."""
    return (None, "None") if days is None else (days * 86_400_000, "ProcessingTime")


def event_state_stream(articles: DataFrame, days: int | None = STATE_DAYS, known: DataFrame | None = None) -> DataFrame:
    """Decisions of streaming articles ``(event_key, id, at, claims, status, …)`` and the merged state of their event after each; needs the RocksDB state store.

    Of ``NUMBERS``, ``TEXTS``, ``status`` and ``claims`` those that are missing count as untold. ``known`` are events of the batch form
    (:func:`newsfold.operators.memory.events_rollup`) to begin with. ``days`` None keeps state for good. Articles of one micro-batch are taken by time, then id.
    Rows without an event key are left out: no event of theirs develops.
    """
    ttl, mode = _lasting(days)
    kinds = {**dict.fromkeys(NUMBERS, "double"), **dict.fromkeys((*TEXTS, "status"), "string"), "claims": "array<string>"}
    column = lambda c, have: (F.col(c) if c in have else F.lit(None)).cast(kinds[c]).alias(c)
    rows = articles.where("event_key is not null").select("event_key", "id", "at", *[column(c, articles.columns) for c in kinds])
    rows = rows.withColumn("status_rank", V.status_rank(F.col("status")))
    kind = dict(articles.dtypes)["event_key"]
    told = {"event_key": kind, "id": "long", "decision": "string", "changed": "string", "new_claims": "int", "article_count": "int", "update_count": "int", **kinds, "key_claims": "array<string>"}
    start = None
    if known is not None:
        kinds["key_claims"] = "array<string>"
        begun = known.select("event_key", "status_rank", "article_count", "update_count", *[column(c, known.columns) for c in (*NUMBERS, *TEXTS, "status", "key_claims")])
        start = settle(begun).groupBy("event_key")  # the stream's own plan stays small
    schema = ", ".join(f"{c} {told[c]}" for c in TOLD)
    return rows.groupBy("event_key").transformWithStateInPandas(EventState(ttl), schema, "Append", mode, start)


class AlertMemory(StatefulProcessor):
    """Shape of the last verdict that reached somebody, and the shapes of alerts that are on their way."""

    def __init__(self, ttl: int | None) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shape = handle.getValueState("shape", "shape string", ttlDurationMs=self.ttl)
        self.sent_before = handle.getValueState("sent_before", "yes boolean", ttlDurationMs=self.ttl)
        self.waiting = handle.getMapState("waiting", "seq long", "shape string", ttlDurationMs=self.ttl)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        self.sent_before.update((True,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        out = []
        for seq, tick, shape, deep, delivered in pd.concat(list(rows)).sort_values("tick")[["seq", "tick", "shape", "deep", "delivered"]].itertuples(index=False):
            number = (int(seq),)
            if shape is None:  # an acknowledgement
                if self.waiting.containsKey(number):
                    if delivered:
                        self.shape.update(self.waiting.getValue(number))
                    self.waiting.removeKey(number)
                continue
            last = self.shape.get()[0] if self.shape.exists() else None
            send = bool(deep) or (shape != last if last is not None else not self.sent_before.exists())
            if send:
                self.waiting.updateValue(number, (shape,))
            out.append((key[0], int(seq), send))
        yield pd.DataFrame(out, columns=["key", "seq", "send"])

    def close(self) -> None:
        pass


def _alert_key() -> Column:
    """An event (an article where there is none) and an asset, as in the batch form."""
    return F.concat_ws(":", F.coalesce(F.col("event_id").cast("string"), F.concat(F.lit("news:"), F.col("news_id").cast("string"))), F.upper("asset")).alias("key")


def alert_memory_stream(alerts: DataFrame, acknowledged: DataFrame | None = None, sent: DataFrame | None = None, days: int | None = STATE_DAYS) -> DataFrame:
    """Whether each streaming alert ``(event_id, news_id, asset, seq, tick, direction, magnitude, confidence, source)`` is sent.

    A verdict is remembered when ``acknowledged(event_id, news_id, asset, seq, tick, delivered)`` says that it reached somebody, so that one that
    didn't is sent again. ``tick`` orders alerts and acknowledgements. Without acknowledgements, what is sent counts as delivered at once. ``sent`` is a batch of
    alerts delivered before the stream began ``(event_id, asset, delivered)``: while a key has no memory of its own, its alerts
    are held unless their verdict is a deep one.
    """
    ttl, mode = _lasting(days)
    ticked = alerts if "tick" in alerts.columns else alerts.withColumn("tick", F.col("seq"))
    shape = F.concat_ws("|", "direction", "magnitude", F.bround(F.col("confidence") * 10).cast("int").cast("string"))
    rows = ticked.select(
        _alert_key(), "seq", F.col("tick").cast("double").alias("tick"), shape.alias("shape"), F.col("source").isin("stage5", "final").alias("deep"), F.lit(None).cast("boolean").alias("delivered")
    )
    if acknowledged is None:  # an acknowledgement right after each alert; for one that was held it says nothing
        both = F.array(F.struct(F.lit(0.0).alias("later"), F.lit(False).alias("ack")), F.struct(F.lit(0.5).alias("later"), F.lit(True).alias("ack")))
        rows = rows.withColumn("x", F.explode(both)).select("key", "seq", (F.col("tick") + F.col("x.later")).alias("tick"), F.when(~F.col("x.ack"), F.col("shape")).alias("shape"), "deep", F.col("x.ack").alias("delivered"))
    else:
        acks = acknowledged.select(_alert_key(), "seq", F.col("tick").cast("double").alias("tick"), F.lit(None).cast("string").alias("shape"), F.lit(False).alias("deep"), "delivered")
        rows = rows.unionByName(acks)
    start = None
    if sent is not None:
        begun = sent.where("delivered and event_id is not null").withColumn("news_id", F.lit(None)).select(_alert_key()).distinct().withColumn("yes", F.lit(True))
        start = settle(begun).groupBy("key")
    return rows.groupBy("key").transformWithStateInPandas(AlertMemory(ttl), "key string, seq long, send boolean", "Append", mode, start)


class SeenMemory(StatefulProcessor):
    """The last ``most`` keys that passed, each with its content, in order of passing: a key's content, its tick, and ticks' keys."""

    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "key string", "content string, tick long")
        self.order = handle.getMapState("order", "tick long", "key string")
        self.bounds = handle.getValueState("bounds", "oldest long, next long, held long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        oldest, next_, held = self.bounds.get() if self.bounds.exists() else (0, 0, 0)
        passed, out = set(), []
        batch = pd.concat(list(rows)).sort_values(["at", "id"])
        for number, name, content in batch[["id", "key", "content"]].itertuples(index=False):
            before = self.seen.getValue((name,)) if self.seen.containsKey((name,)) else None
            new = name not in passed and (before is None or before[0] != content)
            out.append((int(number), new))
            if new:
                passed.add(name)
        # what passed is remembered after the batch, as a pass remembers what it delivered
        for number, name, content in batch[["id", "key", "content"]][[x[1] for x in out]].itertuples(index=False):
            if self.seen.containsKey((name,)):
                self.order.removeKey((self.seen.getValue((name,))[1],))
                held -= 1
            self.seen.updateValue((name,), (content, next_))
            self.order.updateValue((next_,), (name,))
            next_, held = next_ + 1, held + 1
            while held > self.most:
                if self.order.containsKey((oldest,)):
                    self.seen.removeKey((self.order.getValue((oldest,))[0],))
                    self.order.removeKey((oldest,))
                    held -= 1
                oldest += 1
        self.bounds.update((oldest, next_, held))
        yield pd.DataFrame(out, columns=["id", "new"])

    def close(self) -> None:
        pass


def seen_stream(items: DataFrame, most: int = SEEN, buckets: int = 1) -> DataFrame:
    """``(id, new)``: whether each streaming item ``(id, at, key, content)`` is new to a memory of the last ``most`` keys that passed.

    An item passes if its key isn't remembered or was remembered with other content, and no item of its key passed in the same
    micro-batch; what passes is remembered anew, and the longest unrefreshed keys are forgotten. More ``buckets`` (by hash of the key) share
    the work; each then remembers ``most`` keys. A null key or content is a blank one.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = items.select("id", "at", blank("key"), blank("content")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return rows.groupBy("bucket").transformWithStateInPandas(SeenMemory(most), "id long, new boolean", "Append", "None")
