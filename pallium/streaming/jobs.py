"""Structured Streaming versions of masking, restoring, rates, sessions and metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from pallium.operators.audit import session_events
from pallium.operators.detect import detect
from pallium.operators.mask import mask
from pallium.operators.vault import destroy_in_vault

OPENER, CLOSER = "{{SG_", "}}"


def mask_stream(texts: DataFrame, text_col: str = "text", session_col: str = "session_id", **options) -> DataFrame:
    """Masked rows of a text stream. Stateless: tokens are functions of session, type and value."""
    return mask(detect(texts, text_col, **options), text_col, session_col)


def store_vault(write: Callable[[DataFrame, int], None], build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that builds and writes the vault rows of each batch; equal batches make equal tokens."""
    return lambda batch, epoch: write(build(batch), epoch)


def safe_cut(buffer: str, tail: int) -> int:
    """How much of a buffer can be passed on: all but `tail` characters, and never part of a token."""
    opened = buffer.rfind(OPENER)
    if opened >= 0 and buffer.find(CLOSER, opened) < 0:
        return min(opened, max(len(buffer) - tail, 0))
    cut = max(len(buffer) - tail, 0)
    start = buffer.rfind(OPENER, 0, cut + len(OPENER) - 1)
    if start >= 0 and start < cut:
        end = buffer.find(CLOSER, start)
        if end < 0 or end + len(CLOSER) > cut:
            return start
    return cut


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that reordering and session expiry need, for all queries that the session starts from now on. Queries that go on from a checkpoint keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: The next number of a stream that has ended: whatever comes for it is late.
ENDED = 1 << 62


class Reorder(StatefulProcessor):
    """Chunks of one stream in the order of their numbers, and the parts that may go out.

    Chunks that come too early wait in a map by number. A timer runs while any wait, or while nothing comes.
    """

    def __init__(self, first: int, tail: int, gap_ms: int):
        self.first, self.tail, self.gap_ms = first, tail, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next long, part long, buffer string")
        self.waiting = handle.getMapState("waiting", "seq long", "delta string, last boolean")

    def _position(self) -> tuple[int, int, str]:
        return tuple(self.at.get()) if self.at.exists() else (self.first, 0, "")

    def _alarm(self, now: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(now + self.gap_ms)

    def _go(self, key, rows: list, held: dict, flush: bool) -> pd.DataFrame:
        """Passes on what is in order; `held` are the waiting chunks by number."""
        number, part, buffer = self._position()
        ended = False
        while number in held and not ended:
            delta, ended = held.pop(number)
            if self.waiting.containsKey((number,)):
                self.waiting.removeKey((number,))
            buffer, number = buffer + (delta or ""), number + 1
        cut = len(buffer) if ended or flush else safe_cut(buffer, self.tail)
        if cut:
            rows.append((key[0], part, buffer[:cut]))
            part += 1
        if ended:
            # what still waits comes behind the end
            rows += [(key[0], -1 - n, None) for n in sorted(held)]
            self.waiting.clear()
            number, buffer, cut = ENDED, "", 0
        self.at.update((number, part, buffer[cut:]))
        return pd.DataFrame(rows, columns=["stream_id", "part", "text"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        number, late, held = self._position()[0], [], {}
        for pdf in rows:
            for seq, delta, last in pdf[["seq", "delta", "last"]].itertuples(index=False):
                seq = int(seq)
                if seq < number or seq in held or self.waiting.containsKey((seq,)):
                    late.append((key[0], -1 - seq, None))
                else:
                    held[seq] = (delta, bool(last))
        fresh = set(held)
        held |= {int(k[0]): (v[0], bool(v[1])) for k, v in self.waiting.iterator()}
        out = self._go(key, late, held, False)
        for seq in fresh & set(held):
            if self._position()[0] != ENDED:
                self.waiting.updateValue((seq,), held[seq])
        self._alarm(timerValues.getCurrentProcessingTimeInMs())
        yield out

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        number, part, buffer = self._position()
        held, rows = {int(k[0]): (v[0], bool(v[1])) for k, v in self.waiting.iterator()}, []
        if number == ENDED or not held:
            if buffer:
                rows.append((key[0], part, buffer))
            self.at.clear()
        else:
            # the chunks in front of these are given up, in one row
            rows.append((key[0], -1 - number, None))
            self.at.update((min(held), part, buffer))
            rows = self._go(key, rows, held, False).values.tolist()
            self._alarm(timerValues.getCurrentProcessingTimeInMs())
        yield pd.DataFrame(rows, columns=["stream_id", "part", "text"])

    def close(self) -> None:
        pass


def chunk_stream(chunks: DataFrame, tail: int = 96, gap_ms: int = 60_000, first: int = 0) -> DataFrame:
    """(stream_id, part, text) of chunks (stream_id, seq, delta, last): texts in the order of seq, cut so that no token is split.

    Numbers begin at `first`. A chunk that comes early waits for those before it, over micro-batches, up to `gap_ms`
    since the last chunk came; then the missing ones are given up. Given up, and repeated or later than that, they
    are reported by a row with a null text and the part -1 - seq (of the first of them). The rest of a text goes out with
    its last chunk, or after `gap_ms` without one. Sets use_rocksdb() for the session.
    """
    use_rocksdb(chunks.sparkSession)
    kind = chunks.schema["stream_id"].dataType.simpleString()
    return chunks.groupBy("stream_id").transformWithStateInPandas(Reorder(first, tail, gap_ms), f"stream_id {kind}, part long, text string", "Append", "ProcessingTime")


def restore_stream(parts: DataFrame, vault: DataFrame, session_col: str = "stream_id") -> DataFrame:
    """Parts of chunk_stream with exact tokens restored: one stateless join with the vault (session_id, token, value) for each token.

    Texts are cut into tokens and what lies between, tokens are joined within their `session_col`, and a batch puts
    them together again with join_parts: streams cannot be regrouped without a watermark.
    """
    pieces = F.regexp_extract_all("text", F.lit(r"(?s)\{\{SG_[A-Z_]+_[a-f0-9]{6,12}\}\}|(?:(?!\{\{SG_[A-Z_]+_[a-f0-9]{6,12}\}\}).)+"), F.lit(0))
    rows = parts.filter("text is not null").select(*dict.fromkeys(["stream_id", session_col]), "part", F.posexplode(pieces).alias("pos", "piece"))
    known = vault.select(F.col("session_id").alias(session_col), F.col("token").alias("piece"), "value")
    return rows.join(known, [session_col, "piece"], "left").select("stream_id", "part", "pos", F.coalesce("value", "piece").alias("text"))


def join_parts(pieces: DataFrame) -> DataFrame:
    """Batch: the whole text of each stream from restored pieces."""
    listed = F.array_sort(F.collect_list(F.struct("part", "pos", "text")))
    return pieces.groupBy("stream_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "").alias("text"))


def restore_chunks(chunks: DataFrame, vault: DataFrame, tiers: tuple[str, ...] = ("exact",), session_col: str = "stream_id") -> DataFrame:
    """Batch twin: whole texts of (stream_id, seq, delta), restored with the tokens of `session_col` in the vault."""
    from pallium.operators.restore import restore

    listed = F.array_sort(F.collect_list(F.struct("seq", "delta")))
    whole = chunks.groupBy(*dict.fromkeys(["stream_id", session_col])).agg(F.array_join(F.transform(listed, lambda x: x["delta"]), "").alias("text"))
    return restore(whole, vault.withColumnRenamed("stream_id", "session_id"), "text", session_col, tiers)


def session_stream(events: DataFrame, ttl: str = "3600 seconds", watermark: str = "10 minutes", session_col: str = "session_id", ts: str = "ts") -> DataFrame:
    """Sessions that have expired: (session, started, expires, events). Every read or store renews a session."""
    out = events.withWatermark(ts, watermark).groupBy(session_col, F.session_window(ts, ttl).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return out.select(session_col, F.col("w.start").alias("started"), F.col("w.end").alias("expires"), "events")


class Expire(StatefulProcessor):
    """One session at a time for each key, in microseconds of event time; a timer ends it `ttl` after it was last seen."""

    def __init__(self, ttl_us: int):
        self.ttl = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "started long, last_seen long, events long")

    def _row(self, key, session: tuple[int, int, int]) -> tuple:
        return (key[0], session[0], session[1], session[1] + self.ttl, session[2])

    def _frame(self, rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["session", "started", "last_seen", "expires", "events"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        session, ended = tuple(self.session.get()) if self.session.exists() else None, []
        for t in sorted(int(t) for pdf in rows for t in pdf["at_us"]):
            if session is None:
                session = (t, t, 1)
            elif t >= session[1] + self.ttl:
                ended.append(self._row(key, session))
                session = (t, t, 1)
            else:
                session = (min(session[0], t), max(session[1], t), session[2] + 1)
        self.session.update(session)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(-(-(session[1] + self.ttl) // 1000))
        yield self._frame(ended)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = [self._row(key, tuple(self.session.get()))] if self.session.exists() else []
        self.session.clear()
        yield self._frame(rows)

    def close(self) -> None:
        pass


def expired_stream(events: DataFrame, ttl_seconds: int = 3600, watermark: str = "10 minutes", session_col: str = "session_id", ts: str = "ts") -> DataFrame:
    """(session, started, last_seen, expires, events) of sessions as they end, from a stream of their reads and stores.

    Every event renews its session; one that comes `ttl_seconds` or more after the last begins a new session. A session ends when the
    watermark passes its expiry. Events behind the watermark are dropped. Sets use_rocksdb() for the session.
    """
    use_rocksdb(events.sparkSession)
    kind = events.schema[session_col].dataType.simpleString()
    timed = events.withWatermark(ts, watermark).select(F.col(session_col).alias("session"), ts, F.unix_micros(ts).alias("at_us"))
    out = timed.groupBy("session").transformWithStateInPandas(Expire(ttl_seconds * 1_000_000), f"session {kind}, started long, last_seen long, expires long, events long", "Append", "EventTime")
    return out.select(F.col("session").alias(session_col), *[F.timestamp_micros(c).alias(c) for c in ("started", "last_seen", "expires")], "events")


def end_sessions(write: Callable[[DataFrame, int], None], vault_path: str, session_col: str = "session_id") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over expired_stream: `write` gets their SESSION_ENDED audit events, and the vault at that path loses their rows.

    A batch that is run again ends the same sessions: their rows are gone already, and `write` is given the batch's number.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        if not batch.isEmpty():
            destroy_in_vault(batch.sparkSession, vault_path, batch.select(F.col(session_col).alias("session_id")))
            write(session_events(batch, F.unix_micros("expires") / 1e6, session_col), epoch)
        batch.unpersist()

    return run


def rate_stream(calls: DataFrame, limit: int = 60, window_s: float = 60.0) -> DataFrame:
    """Decisions on a stream of calls (client, event_id, ts in seconds); state holds the allowed times of a client.

    An idle client's state goes after twice the window.
    """

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        held, rows = list(state.get[0]) if state.exists else [], []
        for i, t in pd.concat(list(frames)).sort_values(["ts", "event_id"])[["event_id", "ts"]].itertuples(index=False):
            held = [h for h in held if h > t - window_s]
            ok = len(held) < limit
            if ok:
                held.append(float(t))
            rows.append((key[0], int(i), float(t), ok, limit - len(held) if ok else 0))
        state.update((held,))
        state.setTimeoutDuration(int(2000 * window_s))
        yield pd.DataFrame(rows, columns=["client", "event_id", "ts", "allowed", "remaining"])

    kind = calls.schema["client"].dataType.simpleString()
    return calls.groupBy("client").applyInPandasWithState(step, f"client {kind}, event_id long, ts double, allowed boolean, remaining int", "held array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def live_metrics(events: DataFrame, width: str = "5 minutes", watermark: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """(window_start, event_type, n, error_rate) of closed windows; `failed` is a boolean column."""
    out = events.withWatermark(ts, watermark).groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("failed"), 1.0).otherwise(0.0)).alias("error_rate"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "error_rate")
