"""Incremental ingestion of messages, in batches and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import short_id, truncate

OVERLAP, EARLIEST = "5 minutes", "2015-01-01"
#: Compound network ids by prefix, longer ones first; an empty name
#: stands for what follows the prefix.
PREFIXES = [("slackgo", "slack"), ("facebookgo", "facebook"), ("discordgo", "discord"), ("instagramgo", "instagram"), ("beepergo", ""), ("matrix-", "")]
#: Channels of networks.
CHANNELS = {"whatsapp": "whatsapp", "signal": "signal", "facebook": "messenger", "messenger": "messenger", "linkedin": "linkedin_dm", "telegram": "telegram", "instagram": "instagram", "x": "x", "twitter": "x", "discord": "discord", "slack": "slack", "imessage": "imessage"}


def network_of(raw: Column) -> Column:
    """A network's plain name from a compound id; unknown ids in lower case."""
    low = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    out = low
    for prefix, name in reversed(PREFIXES):
        rest = F.regexp_replace(F.substring(low, F.lit(len(prefix) + 1), F.length(low)), r"^[.:-]+", "")
        out = F.when(low.startswith(prefix), F.lit(name) if name else F.coalesce(F.nullif(rest, F.lit("")), F.lit(prefix))).otherwise(out)
    return out


def channel_of(raw: Column) -> Column:
    """The channel of a network; its plain name where none is known."""
    name = network_of(raw)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in CHANNELS.items() for x in kv)), name), name)


def handle_kind(handle: Column) -> Column:
    """email, phone or handle."""
    return F.when(handle.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "email").when(handle.rlike(r"^\+?[\d\s().-]{7,}$"), "phone").otherwise("handle")


def to_records(messages: DataFrame) -> DataFrame:
    """messages (chat, network, id, ts, text, is_sender, attachments, participants
    array of struct(handle, name, self)) -> interaction records. Messages without
    an instant drop out; empty ones get a placeholder."""
    others = F.filter("participants", lambda p: ~p.self)
    pick = lambda kind: F.transform(F.filter(others, lambda p: handle_kind(p.handle) == kind), lambda p: p.handle)
    body = F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.trim("text")).when(F.size("attachments") > 0, "[attachment]").otherwise("[empty]")
    return messages.where("ts is not null").select(
        short_id(F.col("network"), F.col("chat"), F.col("id")).alias("interactionId"),
        F.struct(pick("email").alias("emails"), pick("phone").alias("phones"), pick("handle").alias("handles")).alias("matchCandidates"),
        channel_of(F.col("network")).alias("channel"),
        F.when(F.col("is_sender"), "outbound").otherwise("inbound").alias("direction"),
        F.concat_ws(":", channel_of(F.col("network")), "chat").alias("threadId"),
        F.col("ts").alias("timestamp"),
        truncate(body).alias("summary"),
    )


def ingest_slice(existing: DataFrame, slice_: DataFrame, key: str = "event_id") -> DataFrame:
    """What a slice adds: one row per id that isn't there yet."""
    return slice_.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def ingest_slices(slices: list[DataFrame], key: str = "event_id") -> DataFrame:
    """Overlapping slices, one after the other; equal to their distinct union."""
    have = slices[0].dropDuplicates([key])
    for s in slices[1:]:
        have = have.unionByName(ingest_slice(have, s, key))
    return have


def window_of(since: str | None, cursor: str | None, until: str) -> tuple[str, str]:
    """[from, until) of a run: an explicit start, else the cursor less the
    overlap, else the last day; never before EARLIEST."""
    from datetime import datetime, timedelta

    end = datetime.fromisoformat(until)
    start = datetime.fromisoformat(since) if since else datetime.fromisoformat(cursor) - timedelta(minutes=5) if cursor else end - timedelta(days=1)
    return max(start, datetime.fromisoformat(EARLIEST).replace(tzinfo=end.tzinfo)).isoformat(), end.isoformat()


def read_stream(spark: SparkSession, path: str, schema: str, at: str = "ts", **options: str) -> DataFrame:
    """Files of a folder as a stream; instants without a zone are read as UTC."""
    rows = spark.readStream.schema(schema).options(**options).parquet(path)
    return rows.withColumn(at, F.col(at).cast("timestamp"))


def deduplicated(stream: DataFrame, key: str = "event_id", at: str = "ts", late: str = "24 hours") -> DataFrame:
    """Each id once; the state forgets ids older than `late`."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str = "ts", size: str = "1 day", late: str = "24 hours", *by: str) -> DataFrame:
    """Counts in tumbling windows, closed when the watermark passes."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), *by).agg(F.count(F.lit(1)).alias("n"))


def learn_matches(cache: DataFrame, matched: DataFrame) -> DataFrame:
    """cache (handle, contact_id) with what a batch has matched; the first contact
    learned for a handle stays."""
    fresh = matched.where("handle is not null and contact_id is not null").groupBy("handle").agg(F.min_by("contact_id", "ts").alias("contact_id"))
    return cache.unionByName(fresh.join(cache, "handle", "left_anti"))


def known_contacts(batch: DataFrame, cache: DataFrame) -> DataFrame:
    """A batch (handle, contact_id) with contacts filled in from the cache."""
    known = cache.select("handle", F.col("contact_id").alias("_known"))
    return batch.join(known, "handle", "left").withColumn("contact_id", F.coalesce("contact_id", "_known")).drop("_known")


def run_ingest(stream: DataFrame, target: str, checkpoint: str, contact_of: Callable[[DataFrame], DataFrame] | None = None, unknown: str | None = None, month: str = "ym", at: str = "ts", paused: bool = False) -> StreamingQuery | None:
    """Takes in what is there and stops; offsets advance only on success. Each
    batch is matched to contacts and written by month; rows without a contact
    also go to the unknowns. A batch that runs again writes the same folder."""
    if paused:
        return None

    def write(batch: DataFrame, number: int) -> None:
        rows = contact_of(batch) if contact_of else batch
        rows = rows.withColumn(month, F.date_format(at, "yyyy-MM"))
        rows.write.mode("overwrite").partitionBy(month).parquet(f"{target}/batch={number}")
        if unknown and "contact_id" in rows.columns:
            rows.where("contact_id is null").write.mode("overwrite").parquet(f"{unknown}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_all(starts: dict[str, Callable[[], StreamingQuery | None]]) -> dict[str, str]:
    """One query per source; a source that fails doesn't stop the others."""
    out = {}
    for name, start in starts.items():
        try:
            query = start()
            if query is not None:
                query.awaitTermination()
            out[name] = "ok" if query is not None else "paused"
        except Exception as e:  # recorded: the source's offsets stay where they were
            out[name] = f"error: {str(e)[:200]}"
    return out


# --- matches learned within a stream ----------------------------------------------


def _matcher(keep_ms: int, wait_ms: int):
    """A processor keyed by handle; made when called, as workers need the class itself."""
    from collections.abc import Iterator
    from typing import Any

    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Matcher(StatefulProcessor):
        """Knows a handle's contact from the first row that has one, until no row of
        the handle came for `keep`; rows without a contact wait for it up to `wait`."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.learned = handle.getValueState("learned", "contact_id string, last long")
            self.waiting = handle.getListState("waiting", "event_id long, at long")

        def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
            known = self.learned.get()
            contact, last = (known[0], known[1]) if known is not None else (None, 0)
            own = sorted(((r.at, r.event_id, r.contact_id) for r in rows), key=lambda r: (r[0], r[1]))
            contact = contact or next((c for _, _, c in own if c), None)
            last = max([last, *(at for at, _, _ in own)])
            if contact:
                for event_id, _at in list(self.waiting.get()):
                    yield Row(handle=key[0], event_id=event_id, contact_id=contact, replayed=True)
                self.waiting.clear()
                self.learned.update((contact, last))
                self.handle.registerTimer(last + keep_ms)
            for at, event_id, given in own:
                if given or contact:
                    yield Row(handle=key[0], event_id=event_id, contact_id=given or contact, replayed=False)
                else:
                    self.waiting.appendValue((event_id, at))
                    self.handle.registerTimer(at + wait_ms)

        def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
            now = expiredTimerInfo.getExpiryTimeInMs()
            known = self.learned.get()
            if known is not None and known[1] + keep_ms <= now:
                self.learned.clear()
            left = []
            for event_id, at in list(self.waiting.get()):
                if at + wait_ms <= now:
                    yield Row(handle=key[0], event_id=event_id, contact_id=None, replayed=True)
                else:
                    left.append((event_id, at))
            self.waiting.clear()
            for row in left:
                self.waiting.appendValue(row)

        def close(self) -> None:
            pass

    return Matcher()


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def matched_stream(stream: DataFrame, at: str = "ts", late: str = "24 hours", keep: str = "30 days", wait: str = "30 days") -> DataFrame:
    """stream (handle, event_id, contact_id or null, ts) -> (handle, event_id,
    contact_id, replayed): every event once.

    Repeated events drop out. The contact of a handle is learned from the first
    event that has one and stays; events that came before it are given out again
    with it (replayed), and with none once they have waited longer than `wait` by
    the watermark. What a handle's state holds is its contact and the numbers of
    its waiting events. Events without a handle have no state and pass."""
    from datetime import timedelta

    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    units = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}
    ms = lambda text: int(timedelta(seconds=int(text.split()[0]) * units[text.split()[1].rstrip("s")]).total_seconds() * 1000)
    once = deduplicated(stream.where("handle is not null"), "event_id", at, late)
    rows = once.select("handle", "event_id", "contact_id", F.unix_millis(at).alias("at"), at)
    return rows.groupBy("handle").transformWithState(_matcher(ms(keep), ms(wait)), "handle string, event_id long, contact_id string, replayed boolean", "Append", "EventTime")
