"""Audit events and reports, metrics, and hash chains."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pallium.operators.storage import carried, in_order, previous


def mask_events(masked: DataFrame, ts: Column, session_col: str = "session_id") -> DataFrame:
    return masked.select(ts.alias("ts"), F.lit("TEXT_MASKED").alias("event"), F.col(session_col).alias("session_id"), F.col("entity_count").cast("long").alias("entity_count"), "entity_types")


def restore_events(restored: DataFrame, ts: Column, session_col: str = "session_id") -> DataFrame:
    return restored.select(ts.alias("ts"), F.lit("TEXT_RESTORED").alias("event"), F.col(session_col).alias("session_id"), F.col("tokens_restored").cast("long").alias("tokens_restored"), F.col("tokens_not_found").cast("long").alias("tokens_not_found"))


def session_events(sessions: DataFrame, ts: Column, session_col: str = "session_id") -> DataFrame:
    return sessions.select(ts.alias("ts"), F.lit("SESSION_ENDED").alias("event"), F.col(session_col).alias("session_id"))


def audit_between(events: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Events from the start of day `start` to 23:59:59 of day `end`, both UTC and inclusive."""
    seconds = lambda day, at: F.unix_timestamp(F.lit(f"{day} {at}"))
    if start:
        events = events.filter(F.col("ts") >= seconds(start, "00:00:00"))
    if end:
        events = events.filter(F.col("ts") <= seconds(end, "23:59:59"))
    return events


def _sum_if(event: str, column: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("event") == event, F.col(column))), F.lit(0)).cast("long")


def audit_summary(events: DataFrame) -> DataFrame:
    """One row of totals; status no_data without events."""
    out = events.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("event") == "SESSION_ENDED").alias("total_sessions"),
        _sum_if("TEXT_MASKED", "entity_count").alias("total_entities_masked"),
        _sum_if("TEXT_RESTORED", "tokens_restored").alias("total_tokens_restored"),
    )
    return out.withColumn("status", F.when(F.col("total_events") == 0, "no_data").otherwise("ok"))


def audit_report(events: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return audit_summary(audit_between(events, start, end))


def events_breakdown(events: DataFrame) -> DataFrame:
    return events.groupBy("event").agg(F.count(F.lit(1)).alias("n"))


def entity_types_detected(events: DataFrame) -> DataFrame:
    """Number of masking events that hold each type."""
    return events.filter("event = 'TEXT_MASKED'").select(F.explode(F.array_distinct("entity_types")).alias("entity_type")).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


def entities_masked(detections: DataFrame) -> DataFrame:
    return detections.groupBy("entity_type").agg(F.count(F.lit(1)).alias("entities"))


def requests_by_status(requests: DataFrame) -> DataFrame:
    return requests.groupBy("status").agg(F.count(F.lit(1)).alias("requests"))


def tokens_restored(restored: DataFrame) -> DataFrame:
    return restored.agg(F.coalesce(F.sum("tokens_restored"), F.lit(0)).cast("long").alias("tokens_restored"))


def duration_histogram(requests: DataFrame, buckets: list[float], column: str = "duration") -> DataFrame:
    """(le, n): requests of at most each bound, the last one infinite; one pass, no sort."""
    bounds = [*sorted(buckets), float("inf")]
    sums = requests.agg(*[F.count_if(F.col(column) <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)])).alias("x")).select("x.le", "x.n")


def duration_p99(requests: DataFrame, column: str = "duration", limit: float = 5.0) -> DataFrame:
    p = requests.agg(F.percentile_approx(column, 0.99, 1_000_000).alias("p99"))
    return p.withColumn("alert", F.col("p99") > limit)


def duration_sketches(requests: DataFrame, width: str = "5 minutes", ts: str = "ts", column: str = "duration", k: int = 400) -> DataFrame:
    """(window_start, n, sketch) of each window: KLL sketches, which merge, so longer windows need no request again.

    A quantile's rank is off by about 1.7 / k at most, with high probability; up to k requests are held whole. Windows without a duration have no row.
    """
    out = requests.filter(F.col(column).isNotNull()).groupBy(F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(column, F.lit(k)).alias("sketch"))
    return out.select(F.col("w.start").alias("window_start"), "n", "sketch")


def merged_sketches(sketches: DataFrame, unit: str = "day", k: int = 400) -> DataFrame:
    """(window_start, n, sketch) by hour, day, week ... of the sketches of shorter windows."""
    return sketches.groupBy(F.date_trunc(unit, "window_start").alias("window_start")).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def sketched_p99(sketches: DataFrame, limit: float = 5.0, rank: float = 0.99) -> DataFrame:
    """(window_start, n, p99, alert) of sketches."""
    return sketches.select("window_start", "n", F.kll_sketch_get_quantile_double("sketch", F.lit(rank)).alias("p99")).withColumn("alert", F.col("p99") > limit)


def active_sessions(sessions: DataFrame, limit: int = 100, bucket: str = "day") -> DataFrame:
    """(ts, active, alert): sessions open after each change; sessions have started and ended.

    A running sum per bucket is added to the sums of the buckets before, so that no task holds all changes.
    """
    changes = sessions.select(F.explode(F.array(F.struct(F.col("started").alias("ts"), F.lit(1).alias("d")), F.struct(F.col("ended").alias("ts"), F.lit(-1).alias("d")))).alias("c")).select("c.*").filter("ts is not null")
    by_ts = changes.groupBy("ts").agg(F.sum("d").alias("d")).withColumn("bucket", F.date_trunc(bucket, "ts"))
    before = by_ts.groupBy("bucket").agg(F.sum("d").alias("s")).withColumn("base", F.sum("s").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))).select("bucket", F.coalesce("base", F.lit(0)).alias("base"))
    running = F.sum("d").over(W.partitionBy("bucket").orderBy("ts").rowsBetween(W.unboundedPreceding, 0))
    out = by_ts.withColumn("r", running).join(before, "bucket").select("ts", (F.col("base") + F.col("r")).cast("long").alias("active"))
    return out.withColumn("alert", F.col("active") > limit)


def error_rate(requests: DataFrame, width: str = "5 minutes", limit: float = 0.1, ts: str = "ts", failed: Column | None = None) -> DataFrame:
    bad = failed if failed is not None else F.col("status") == "error"
    out = requests.groupBy(F.window(ts, width).alias("w")).agg(F.avg(F.when(bad, 1.0).otherwise(0.0)).alias("rate"))
    return out.select(F.col("w.start").alias("window_start"), "rate", (F.col("rate") > limit).alias("alert"))


# --- hash chains -------------------------------------------------------------------------------------------

GENESIS = "GENESIS"


def _quoted(text: Column) -> Column:
    """A JSON string in ASCII: quotes, backslashes, control characters and all beyond ASCII are escaped, by UTF-16 units."""
    short = F.create_map(*[F.lit(x) for pair in {"0022": '\\"', "005C": "\\\\", "0008": "\\b", "0009": "\\t", "000A": "\\n", "000C": "\\f", "000D": "\\r"}.items() for x in pair])

    def unit(u: Column) -> Column:
        plain = F.when(u.between("0020", "007E"), F.char(F.conv(u, 16, 10).cast("int")))
        return F.coalesce(F.element_at(short, u), plain, F.concat(F.lit("\\u"), F.lower(u)))

    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    return F.concat(F.lit('"'), F.when(text.rlike(r'[^ !#-\[\]-~]'), F.array_join(F.transform(units, unit), "")).otherwise(text), F.lit('"'))


def canonical_entry(data: Column, event: Column, prev_hash: Column, sequence: Column, timestamp: Column) -> Column:
    """JSON of an entry with sorted keys, ', ' and ': ' between its parts; `data` is canonical JSON already."""
    return F.concat(F.lit('{"data": '), data, F.lit(', "event": '), _quoted(event), F.lit(', "prev_hash": '), _quoted(prev_hash), F.lit(', "sequence": '), sequence.cast("string"), F.lit(', "timestamp": '), _quoted(timestamp), F.lit("}"))


def _canonical(data: str, event: str | None, prev_hash: str | None, sequence: int, timestamp: str | None) -> str | None:
    """canonical_entry of plain values."""
    if data is None or event is None or prev_hash is None or timestamp is None:
        return None
    return f'{{"data": {data}, "event": {json.dumps(event)}, "prev_hash": {json.dumps(prev_hash)}, "sequence": {sequence}, "timestamp": {json.dumps(timestamp)}}}'


def _canonical_json(data: str | None) -> str | None:
    """The same JSON with sorted keys, in ASCII. What isn't JSON becomes a JSON string."""
    try:
        return None if data is None else json.dumps(json.loads(data), sort_keys=True)
    except ValueError:
        return json.dumps(data)


def build_chain(entries: DataFrame, chain_col: str = "chain_id", order_col: str = "ts", heads: DataFrame | None = None) -> DataFrame:
    """(chain, sequence, timestamp, event, data, prev_hash, entry_hash) of entries (timestamp, event, data).

    With `heads` (chain, next_sequence, last_hash; one row for each chain) chains go on where they ended, so that a chain
    of some entries, and one of the next from its head, are together the chain of all. Chains without a head begin anew;
    heads without entries are ignored.

    Each hash needs the one before: rows of a chain are streamed through one task, sorted by Spark, which holds
    the last hash only. Logs are cut into chains (a day, a writer) by `chain_col` to work side by side. Ties of
    the order are settled by the entry's own fields. `data` is put into canonical form.
    """
    kind = entries.schema[chain_col].dataType.simpleString()
    names = ["sequence", "timestamp", "event", "data", "prev_hash", "entry_hash"]

    def chained(batches):
        last, n, prev = object(), 0, GENESIS
        for batch in batches:
            numbers, before, hashes, written = [], [], [], []
            taken = []
            for i, (chain, timestamp, event, data, head, head_hash) in enumerate(zip(*[batch.column(c).to_pylist() for c in (chain_col, "timestamp", "event", "data", "_head", "_hash")], strict=True)):
                if chain != last:
                    last, n, prev = chain, 0, GENESIS
                if head is not None:
                    # heads are sorted in front of the entries of their chains
                    n, prev = head, head_hash
                    continue
                taken.append(i)
                data = _canonical_json(data)
                written.append(data)
                entry = _canonical(data, event, prev, n, timestamp)
                numbers.append(n)
                before.append(prev)
                prev = None if entry is None else hashlib.sha256(entry.encode()).hexdigest()
                hashes.append(prev)
                n += 1
            batch = batch.take(pa.array(taken, pa.int64()))
            fields = [pa.array(numbers, pa.int32()), *[batch.column(c) for c in ("timestamp", "event")], pa.array(written, pa.string()), pa.array(before, pa.string()), pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(chain_col), *fields], [chain_col, *names])

    rows = entries.select(chain_col, F.lit(1).alias("_is_entry"), F.col(order_col).alias("_order"), "timestamp", "event", "data", F.lit(None).cast("int").alias("_head"), F.lit(None).cast("string").alias("_hash"))
    if heads is not None:
        blank = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema}
        begin = heads.filter("next_sequence is not null and last_hash is not null")
        rows = rows.unionByName(begin.select(chain_col, F.lit(0).alias("_is_entry"), *[blank[c] for c in ("_order", "timestamp", "event", "data")], F.col("next_sequence").cast("int").alias("_head"), F.col("last_hash").alias("_hash")))
    dealt = rows.repartition(chain_col).sortWithinPartitions(chain_col, "_is_entry", "_order", "timestamp", "event", "data").drop("_order", "_is_entry")
    return dealt.mapInArrow(chained, f"`{chain_col}` {kind}, sequence int, timestamp string, event string, data string, prev_hash string, entry_hash string")


def chain_head(chain: DataFrame, chain_col: str = "chain_id") -> DataFrame:
    """(chain, next_sequence, last_hash) to resume with."""
    return chain.groupBy(chain_col).agg((F.max("sequence") + 1).alias("next_sequence"), F.max_by("entry_hash", "sequence").alias("last_hash"))


def resume_heads(lines: DataFrame, chain_col: str = "chain_id") -> DataFrame:
    """(chain, next_sequence, last_hash) of stored entries to go on from. A chain with a malformed line (null event) has none, so it begins anew behind what is stored."""
    out = lines.groupBy(chain_col).agg((F.max("sequence") + 1).alias("next_sequence"), F.max_by("entry_hash", "sequence").alias("last_hash"), F.count_if(F.col("event").isNull()).alias("_malformed"))
    return out.filter("_malformed = 0").drop("_malformed")


def verify_chain(lines: DataFrame, chain_col: str = "chain_id", pos_col: str = "pos") -> DataFrame:
    """(chain, valid, entries_checked, first_broken_at, errors) of stored entries in the order of `pos`.

    A row with a null event is a malformed line: an error, reported by its position, and skipped by the links.
    Others are reported by their sequence. errors counts hash mismatches, broken links and malformed lines.

    Lines are sorted by ranges of (chain, pos), so a long chain is checked by many tasks. A task reads its range once, and
    makes one row for each chain in it: what it found, the first link, which only the range before can check, and the
    last hash, which it hands to the range behind.
    """
    tampered = ~F.sha2(canonical_entry(F.col("data"), F.col("event"), F.col("prev_hash"), F.col("sequence"), F.col("timestamp")), 256).eqNullSafe(F.col("entry_hash"))
    kind = lines.schema[chain_col].dataType.simpleString()
    rows = lines.select(F.col(chain_col).alias("chain"), F.col(pos_col).cast("double").alias("pos"), F.col("event").isNotNull().alias("good"), tampered.alias("tampered"), "prev_hash", "entry_hash", F.coalesce(F.when(F.col("event").isNotNull(), F.col("sequence")).cast("long"), F.col(pos_col).cast("long")).alias("name"))
    fields = "begin double, checked long, errors long, broken_pos double, broken_at long, first_pos double, first_at long, first_prev string, first_bad boolean, last_hash string"

    def check(batches):
        run = None
        for batch in batches:
            for chain, pos, good, bad, prev, hash_, name in zip(*[batch.column(c).to_pylist() for c in ("chain", "pos", "good", "tampered", "prev_hash", "entry_hash", "name")], strict=True):
                if run is None or run["chain"] != chain:
                    if run is not None:
                        yield run
                    run = {"chain": chain, "begin": pos, "checked": 0, "errors": 0, "broken_pos": None, "broken_at": None, "first_pos": None, "first_at": None, "first_prev": None, "first_bad": None, "last_hash": None}
                wrong = 1
                if good:
                    wrong = int(bad)
                    if run["checked"] == 0:
                        run |= {"first_pos": pos, "first_at": name, "first_prev": prev, "first_bad": bool(bad)}
                    else:
                        wrong += prev != run["last_hash"]
                    run["checked"] += 1
                    run["last_hash"] = hash_
                if wrong:
                    run["errors"] += wrong
                    if run["broken_pos"] is None:
                        run |= {"broken_pos": pos, "broken_at": name}
        if run is not None:
            yield run

    def runs(batches):
        held = []
        for r in check(batches):
            held.append(r)
            if len(held) == 1000:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    schema = to_arrow_schema(StructType.fromDDL(f"chain {kind}, {fields}"))
    found = rows.repartitionByRange("chain", "pos").sortWithinPartitions("chain", "pos").mapInArrow(runs, f"chain {kind}, {fields}")
    # a row for each range that a chain reaches into; the last hash goes over ranges that hold malformed lines only
    order = W.partitionBy("chain").orderBy("begin")
    before = F.coalesce(F.last("last_hash", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(GENESIS))
    linked = found.withColumn("_torn", (F.col("checked") > 0) & ~F.col("first_prev").eqNullSafe(before))
    sooner = F.col("_torn") & (F.col("broken_pos").isNull() | (F.col("first_pos") <= F.col("broken_pos")))
    one = linked.select("chain", "checked", (F.col("errors") + F.col("_torn").cast("long")).alias("errors"), F.when(sooner, F.col("first_pos")).otherwise(F.col("broken_pos")).alias("pos"), F.when(sooner, F.col("first_at")).otherwise(F.col("broken_at")).alias("at"))
    out = one.groupBy("chain").agg(F.sum("checked").alias("entries_checked"), F.min_by("at", F.when(F.col("errors") > 0, F.col("pos"))).alias("first_broken_at"), F.sum("errors").alias("errors"))
    return out.select(F.col("chain").alias(chain_col), (F.col("errors") == 0).alias("valid"), "entries_checked", "first_broken_at", "errors")


# --- rates and sessions ------------------------------------------------------------------------------------


def rate_decisions(calls: DataFrame, key: str = "client", ts: str = "ts", limit: int = 60, window_s: float = 60.0, id_col: str = "event_id") -> DataFrame:
    """(key, id, ts, allowed, remaining): a call is allowed if fewer than `limit` allowed ones lie in (ts - window, ts].

    `ts` is in seconds. A pause of a window or more forgets all calls before it, so each stretch of calls between
    pauses is one fold in time order, which holds at most `limit` times. Calls are sorted by ranges of (key, ts), and the last
    call of a range is handed to the next, so finding the pauses takes no task that holds all calls of a busy key.
    Its stretches go to many tasks, and a long one is streamed through, which needs no more memory.
    """
    schema = f"`{key}` {calls.schema[key].dataType.simpleString()}, `{id_col}` {calls.schema[id_col].dataType.simpleString()}, `{ts}` double, allowed boolean, remaining int"

    def decide(batches):
        last, held = object(), []
        for pdf in batches:
            out = []
            for *k, i, t in pdf.itertuples(index=False):
                if k != last:
                    last, held = k, []
                held = [h for h in held if h > t - window_s]
                ok = len(held) < limit
                if ok:
                    held.append(t)
                out.append((ok, limit - len(held) if ok else 0))
            yield pdf.drop(columns="_stretch").assign(allowed=[o[0] for o in out], remaining=[o[1] for o in out])

    rows = in_order(calls.select(key, id_col, F.col(ts).cast("double").alias(ts)), F.col(key), F.col(ts), F.col(id_col), name="calls")
    rows = previous(rows, F.struct(F.col(key).alias("key"), F.col(ts).alias("ts")), "_last")
    begins = F.col("_last").isNull() | ~F.col("_last.key").eqNullSafe(F.col(key)) | F.coalesce(F.col("_last.ts") <= F.col(ts) - window_s, F.lit(False))
    # a stretch is known by the number of its first call
    rows = carried(rows, F.when(begins, F.col("at")), "_stretch").select(key, "_stretch", id_col, ts)
    return rows.repartition(key, "_stretch").sortWithinPartitions(key, "_stretch", ts, id_col).mapInPandas(decide, schema)


def session_activity(events: DataFrame, session_col: str = "session_id", ts: str = "ts", ttl: str = "3600 seconds") -> DataFrame:
    """(session, started, last_seen, expires, events): a session lives till `ttl` passes without a read or store."""
    out = events.groupBy(session_col, F.session_window(ts, ttl).alias("w")).agg(F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("events"))
    return out.select(session_col, F.col("w.start").alias("started"), "last_seen", F.col("w.end").alias("expires"), "events")
