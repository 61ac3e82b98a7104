"""The four tumbling-window mule rules.

Group = ``(rule_type, key, currency, epoch-aligned window on occurred_at)``.
A rule fires at the first event, in arrival order ``(ingested_at, event_id)``,
at which the window holds at least ``min_distinct`` counterparties and, when
switched on, ``min_count`` events and ``min_amount`` in total.  The candidate
carries the window state as of that event.

Because validated amounts are positive, distinct count, count and sum only
grow, so *whether* a group fires is a plain ``GROUP BY ... HAVING`` over the
whole window (W6, map-side partial aggregation).  *Where* it fires is the
latest of three monotone crossing points, each found without sorting a whole
group in one task:

* distinct: the ``min_distinct``-th first sighting of a counterparty,
* count:    the ``min_count``-th event,
* amount:   the first event whose running sum reaches ``min_amount``.

The first two are top-k per group (``row_number() <= k`` plans as a partial
``WindowGroupLimit`` before the shuffle, so a hot group is cut down map-side).
The third is a two-level prefix sum: per-second segment totals, a running sum
over segments, and a row-level running sum inside the one crossing segment.

The on-time rows are written once, with ids as 16 bytes where all of them are canonical UUIDs, and aggregated once, per
``(group, counterparty)``.  Ranked by first arrival and cut at ``min_distinct`` per group, that table decides which groups reach the
distinct threshold, where, and whom the snapshot names; it is kept only up to there unless a rule has further thresholds.
The rows themselves are read twice: for it, and for counts, amounts and transactions up to the crossing.
Which rows are late is looked up per rule and window in the arrivals that close them; no row is moved for it.
Evidence (W10) leaves as one row per account and transaction; only candidates carry arrays.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowwatch.config import DEFAULT_RULES, RULE_SHAPES, RuleConfig
from flowwatch.functions import (
    all_canonical, arrival, epoch_micros, epoch_millis, name_uuid, pack_uuid, shift_micros, tumbling_start, unpack_uuid,
)
from flowwatch.operators.activity import activity as activity_rows, packed_events
from flowwatch.session import kept

#: A group; sorts compare it column by column, so the columns with many values come first.  window_end follows from start + rule.
GROUP = ["key", "window_start", "rule_type", "currency"]


def _per_rule(rules: tuple[RuleConfig, ...], attr: str) -> Column:
    expr = None
    for r in rules:
        cond = F.col("rule_type") == F.lit(r.rule_type)
        value = F.lit(int(getattr(r, attr)))
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr.cast("long")


def windowed(activity: DataFrame, rules: Iterable[RuleConfig] = DEFAULT_RULES, with_end: bool = False) -> DataFrame:
    """Add ``window_start`` (and ``window_end``) with each rule's own window size."""
    rules = tuple(rules)
    seconds = _per_rule(rules, "window_seconds")
    out = activity.withColumn("window_start", tumbling_start(F.col("occurred_at"), seconds))
    return with_window_end(out, rules) if with_end else out


def with_window_end(df: DataFrame, rules) -> DataFrame:
    seconds = _per_rule(tuple(rules), "window_seconds")
    return df.withColumn("window_end", shift_micros(F.col("window_start"), seconds * 1_000_000))


def _fires(rules, distinct: Column, count: Column, amount: Column) -> Column:
    d = _per_rule(rules, "min_distinct")
    c = _per_rule(rules, "min_count")
    a = _per_rule(rules, "min_amount")
    return (distinct >= d) & ((c <= 0) | (count >= c)) & ((a <= 0) | (amount >= a))


def window_totals(activity: DataFrame, rules: Iterable[RuleConfig] = DEFAULT_RULES) -> DataFrame:
    rules = tuple(rules)
    t = (windowed(activity, rules).groupBy(*GROUP).agg(
        F.count_distinct("counterparty").cast("int").alias("distinct_accounts_count"),
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum("amount_minor").alias("total_amount_minor")))
    return with_window_end(t, rules).select("rule_type", "key", "currency", "window_start", "window_end", "distinct_accounts_count",
                                            "transaction_count", "total_amount_minor")


def window_final(activity: DataFrame, rules: Iterable[RuleConfig] = DEFAULT_RULES) -> DataFrame:
    """Groups that fire, with whole-window totals (same group set as W5)."""
    rules = tuple(rules)
    t = window_totals(activity, rules)
    return t.where(_fires(rules, F.col("distinct_accounts_count"),
                          F.col("transaction_count"), F.col("total_amount_minor")))


def _kth(df: DataFrame, rules, attr: str, alias: str) -> DataFrame:
    """Arrival of the k-th row (by ``arr``) per group, k per rule."""
    ks = [int(getattr(r, attr)) for r in rules if getattr(r, attr) > 0]
    if not ks:
        return None
    k = _per_rule(rules, attr)
    w = Window.partitionBy(*GROUP).orderBy("arr")
    return (df.withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") <= max(ks))          # literal bound -> partial top-k
            .where(F.col("_rn") == k)
            .select(*GROUP, F.col("arr").alias(alias)))


def _amount_crossing(ev: DataFrame, rules) -> DataFrame | None:
    """Arrival of the first event whose running window sum reaches min_amount."""
    if not any(r.min_amount > 0 for r in rules):
        return None
    a = _per_rule(rules, "min_amount")
    ev = ev.where(a > 0).withColumn("_seg", F.floor(epoch_micros(F.col("arr.ts")) / 1_000_000))
    seg = ev.groupBy(*GROUP, "_seg").agg(F.sum("amount_minor").alias("_seg_sum"))
    by_seg = Window.partitionBy(*GROUP).orderBy("_seg").rowsBetween(Window.unboundedPreceding, 0)
    seg = seg.withColumn("_cum", F.sum("_seg_sum").over(by_seg))
    first_seg = Window.partitionBy(*GROUP).orderBy("_seg")
    hit = (seg.where(F.col("_cum") >= a)
           .withColumn("_rn", F.row_number().over(first_seg)).where(F.col("_rn") == 1)
           .select(*GROUP, "_seg", (F.col("_cum") - F.col("_seg_sum")).alias("_before")))
    in_seg = Window.partitionBy(*GROUP, "_seg").orderBy("arr").rowsBetween(Window.unboundedPreceding, 0)
    first_row = Window.partitionBy(*GROUP).orderBy("arr")
    return (ev.join(hit, GROUP + ["_seg"])
            .withColumn("_run", F.col("_before") + F.sum("amount_minor").over(in_seg))
            .where(F.col("_run") >= a)
            .withColumn("_rn", F.row_number().over(first_row)).where(F.col("_rn") == 1)
            .select(*GROUP, F.col("arr").alias("_p_amount")))


COUNTERPARTY = ["counterparty", "first", "events", "amount"]


def counterparties(rows: DataFrame) -> DataFrame:
    """One row per (group, counterparty): first arrival, events and amount.  ``rows`` are windowed and have ``arr``."""
    return rows.groupBy(*GROUP, "counterparty").agg(
        F.min("arr").alias("first"), F.count(F.lit(1)).alias("events"), F.sum("amount_minor").alias("amount"))


def crossings(rows: DataFrame, per_cp: DataFrame, rules: Iterable[RuleConfig] = DEFAULT_RULES) -> DataFrame:
    """(group, crossing): arrival of the crossing event of every firing group."""
    rules = tuple(rules)
    totals = per_cp.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_d"), F.sum("events").alias("_n"), F.sum("amount").alias("_s"))
    fired = totals.where(_fires(rules, F.col("_d"), F.col("_n"), F.col("_s"))).select(*GROUP)
    parts = [_kth(per_cp.join(fired, GROUP, "left_semi").withColumn("arr", F.col("first")), rules, "min_distinct", "_p_distinct")]
    if any(r.min_count > 0 or r.min_amount > 0 for r in rules):
        of_fired = rows.join(fired, GROUP, "left_semi")
        parts += [_kth(of_fired, rules, "min_count", "_p_count"), _amount_crossing(of_fired, rules)]
    parts = [p for p in parts if p is not None]
    joined = reduce(lambda l, r: l.join(r, GROUP, "left"), parts)
    names = [c for c in joined.columns if c.startswith("_p_")]
    point = F.greatest(*[F.col(n) for n in names]) if len(names) > 1 else F.col(names[0])
    return joined.select(*GROUP, point.alias("crossing"))


def _reaching(per_cp: DataFrame, rules) -> DataFrame:
    """Counterparties up to the ``min_distinct``-th of every group that has so many, with ``crossing``, the arrival of that one,
    and ``lead``, true in one row of each group."""
    k = _per_rule(rules, "min_distinct")
    by_first, whole = Window.partitionBy(*GROUP).orderBy("first"), Window.partitionBy(*GROUP)
    return (per_cp.select(*GROUP, "counterparty", "first")
            .withColumn("_rank", F.rank().over(by_first))
            .where(F.col("_rank") <= max(int(r.min_distinct) for r in rules))     # literal bound -> partial top-k
            .where(F.col("_rank") <= k)
            .withColumns({"_n": F.count(F.lit(1)).over(whole), "crossing": F.max("first").over(whole),
                          "lead": F.row_number().over(by_first) == 1})
            .where(F.col("_n") >= k).drop("_rank", "_n"))


def _crossed(rows: DataFrame, rules, keep) -> tuple[DataFrame, DataFrame]:
    """(counterparties, crossings) of windowed rows, the counterparties of groups that do not fire left out where that is known."""
    per_cp = counterparties(rows)
    if any(r.min_count > 0 or r.min_amount > 0 for r in rules):
        per_cp = keep(per_cp, "rule-counterparties")
        return per_cp, keep(crossings(rows, per_cp, rules), "rule-crossings")
    top = keep(_reaching(per_cp, rules), "rule-counterparties")
    cross = keep(top.where("lead").select(*GROUP, "crossing"), "rule-crossings")
    return top.drop("crossing", "lead"), cross


def _account_keyed() -> Column:
    return F.col("rule_type").isin([name for name, shape in RULE_SHAPES.items() if not shape[2]])


def _packed(activity: DataFrame) -> DataFrame:
    """Activity with ids as bytes, in the order of the texts, for each kind of id of which every one is a canonical UUID."""
    accounts = [F.when(_account_keyed(), F.col("key")), F.col("counterparty")]
    fine = activity.agg(all_canonical(accounts).alias("account"), all_canonical([F.col("event_id")]).alias("event"),
                        all_canonical([F.col("transaction_id")]).alias("transaction")).first()
    if fine.account:
        activity = activity.withColumns({"key": F.when(_account_keyed(), pack_uuid(F.col("key"))).otherwise(F.col("key").cast("binary")),
                                         "counterparty": pack_uuid(F.col("counterparty"))})
    for kind in ("event", "transaction"):
        if fine[kind]:
            activity = activity.withColumn(f"{kind}_id", pack_uuid(F.col(f"{kind}_id")))
    return activity


def _text(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with packed ids as texts again."""
    types = dict(df.dtypes)
    for c in columns:
        if types[c] == "binary":
            plain = unpack_uuid(F.col(c))
            df = df.withColumn(c, F.when(_account_keyed(), plain).otherwise(F.decode(F.col(c), "UTF-8")) if c == "key" else plain)
        elif types[c] == "array<binary>":
            df = df.withColumn(c, F.transform(c, unpack_uuid))
    return df


def identity(df: DataFrame, rules: Iterable[RuleConfig] = DEFAULT_RULES) -> DataFrame:
    """Deduplication key, candidate id and primary account of a group."""
    rules = tuple(rules)
    hashed = [r.rule_type for r in rules if r.hashed_primary]
    key = F.format_string("%s-%s-%s-%d", F.col("rule_type"), F.col("key"), F.col("currency"),
                          epoch_millis(F.col("window_start")))
    return (df.withColumn("deduplication_key", key)
            .withColumn("candidate_id", name_uuid(F.col("deduplication_key")))
            .withColumn("primary_account_id",
                        F.when(F.col("rule_type").isin(hashed), name_uuid(F.col("key")))
                        .otherwise(F.col("key"))))


CANDIDATE_OUT = ["candidate_id", "deduplication_key", "rule_type", "primary_account_id",
                 "window_start", "window_end", "distinct_accounts_count", "transaction_count",
                 "total_amount_minor", "currency", "involved_accounts", "transaction_ids",
                 "generated_at", "trigger_event_id"]


ROW = [*GROUP, "counterparty", "arr", "amount_minor", "transaction_id"]


def _rows(activity: DataFrame, rules) -> DataFrame:
    return windowed(activity, rules).withColumn("arr", arrival()).select(*ROW)


def _keeping(materialize: bool):
    return kept if materialize else (lambda df, name: df)


def _shared(activity: DataFrame, rules, materialize: bool, packed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(windowed rows, their counterparties, crossings): what candidates and evidence are made of."""
    keep = _keeping(materialize)
    rows = keep(_rows(_packed(activity) if materialize and not packed else activity, rules), "rule-rows")
    return rows, *_crossed(rows, rules, keep)


def first_crossing(activity: DataFrame, rules: Iterable[RuleConfig] = DEFAULT_RULES,
                   generated_at: Column | None = None, materialize: bool = True) -> DataFrame:
    """W5 + W8: one ``fraud_candidate`` per firing group, state as of the crossing.

    A crossing event that is delivered several times counts as often as it takes to cross,
    once in general.  ``generated_at`` defaults to the arrival time of the crossing event.
    """
    rules = tuple(rules)
    return _candidates(*_shared(activity, rules, materialize), rules, generated_at)


def firing(activity: DataFrame, rules: Iterable[RuleConfig] = DEFAULT_RULES, materialize: bool = True) -> DataFrame:
    """W5 + W8 without the window's state: identity, ``generated_at`` and ``trigger_event_id`` of every firing group."""
    rules = tuple(rules)
    cross = _crossed(_rows(_packed(activity) if materialize else activity, rules), rules, _keeping(materialize))[1]
    fired = _text(cross.withColumns({"generated_at": F.col("crossing.ts"), "trigger_event_id": F.col("crossing.id")}), "key", "trigger_event_id")
    return identity(with_window_end(fired, rules), rules).drop("key", "crossing")


def _candidates(rows: DataFrame, per_cp: DataFrame, cross: DataFrame, rules, generated_at: Column | None = None) -> DataFrame:
    before = F.col("arr") < F.col("crossing")
    amount_before = F.coalesce(F.sum(F.when(before, F.col("amount_minor"))), F.lit(0))
    named = (per_cp.join(cross, GROUP).where(F.col("first") <= F.col("crossing")).groupBy(*GROUP).agg(
        F.count(F.lit(1)).cast("int").alias("distinct_accounts_count"),
        F.sort_array(F.collect_list("counterparty")).alias("involved_accounts")))
    counted = (rows.join(cross, GROUP).where(F.col("arr") <= F.col("crossing"))
               .groupBy(*GROUP).agg(
                   F.count_if(before).alias("_count"), amount_before.alias("_amount"),
                   F.max(F.when(~before, F.col("amount_minor"))).alias("_last"),
                   F.sort_array(F.collect_set("transaction_id")).alias("transaction_ids"),
                   F.max("crossing").alias("crossing")))
    snap = (counted.join(named, GROUP)
            .withColumn("_short", _per_rule(rules, "min_amount") - F.col("_amount"))
            .withColumn("_copies", F.greatest(F.lit(1), _per_rule(rules, "min_count") - F.col("_count"),
                                              F.expr("(_short + _last - 1) div _last")))
            .withColumn("transaction_count", F.col("_count") + F.col("_copies"))
            .withColumn("total_amount_minor", F.col("_amount") + F.col("_copies") * F.col("_last")))
    stamp = generated_at if generated_at is not None else F.col("crossing.ts")
    snap = _text(snap.withColumn("trigger_event_id", F.col("crossing.id")), "key", "involved_accounts", "transaction_ids", "trigger_event_id")
    return (identity(with_window_end(snap, rules), rules)
            .withColumn("generated_at", stamp)
            .select(*CANDIDATE_OUT))


def _taken(events: DataFrame, rules, drop_late: bool, bucket_seconds: int, packed: bool = False) -> DataFrame:
    """Activity of the events, their ids packed before they are dealt to the rules."""
    act = activity_rows(events if packed else packed_events(events)[0], rules)
    return on_time(act, rules, bucket_seconds) if drop_late else act


def candidates(events: DataFrame, rules: Iterable[RuleConfig] = DEFAULT_RULES,
               drop_late: bool = True, bucket_seconds: int = 1, packed: bool = False) -> DataFrame:
    """Validated events -> fraud candidates of all configured rules; late rows take no part unless ``drop_late`` is off.
    ``packed``: the events are those of ``packed_events``."""
    rules = tuple(rules)
    return _candidates(*_shared(_taken(events, rules, drop_late, bucket_seconds, packed), rules, True, packed=True), rules)


def evidence(events: DataFrame, rules: Iterable[RuleConfig] = DEFAULT_RULES, drop_late: bool = True,
             bucket_seconds: int = 1) -> DataFrame:
    """(deduplication_key, kind, value), one row per account and transaction of a candidate, without arrays on the way."""
    rules = tuple(rules)
    rows, per_cp, cross = _shared(_taken(events, rules, drop_late, bucket_seconds), rules, True, packed=True)
    accounts = per_cp.join(cross, GROUP).where(F.col("first") <= F.col("crossing")).select(
        *GROUP, F.lit("account").alias("kind"), F.col("counterparty").alias("value"))
    accounts, rows = _text(accounts, "key", "value"), rows.select(*GROUP, "arr", "transaction_id")
    transactions = rows.join(cross, GROUP).where(F.col("arr") <= F.col("crossing")).select(
        *GROUP, F.lit("transaction").alias("kind"), F.col("transaction_id").alias("value")).distinct()
    transactions = _text(transactions, "key", "value")
    return identity(accounts.unionByName(transactions), rules).select("deduplication_key", "kind", "value")


_BUCKETS_PER_SPAN = 3600


def _with_stream_time(activity: DataFrame, rules, bucket_seconds: int) -> DataFrame:
    """Add ``window_start``, ``window_end``, ``stream_time`` and ``late``.

    Stream time of a row = max ``occurred_at`` among rows of the same rule that
    arrived strictly before it; the row is late when
    ``window_end + grace <= stream time``.  The running max has three levels: spans
    of an hour of buckets (one row per rule and span), buckets inside a span, rows inside a bucket.
    """
    grace = _per_rule(rules, "grace_seconds")
    w = (windowed(activity, rules, with_end=True).withColumn("arr", arrival())
         .withColumn("_bucket", F.floor(epoch_micros(F.col("ingested_at")) / (bucket_seconds * 1_000_000))))
    buckets = (w.groupBy("rule_type", "_bucket").agg(F.max("occurred_at").alias("_bmax"))
               .withColumn("_span", F.floor(F.col("_bucket") / _BUCKETS_PER_SPAN)))
    before_span = Window.partitionBy("rule_type").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = (buckets.groupBy("rule_type", "_span").agg(F.max("_bmax").alias("_smax"))
             .select("rule_type", "_span", F.max("_smax").over(before_span).alias("_before")))
    in_span = Window.partitionBy("rule_type", "_span").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (buckets.withColumn("_ins", F.max("_bmax").over(in_span)).join(spans, ["rule_type", "_span"])
               .select("rule_type", "_bucket", F.greatest("_before", "_ins").alias("_prior")))
    in_bucket = Window.partitionBy("rule_type", "_bucket").orderBy("arr").rowsBetween(Window.unboundedPreceding, -1)
    rows = w.withColumn("_inb", F.max("occurred_at").over(in_bucket)).join(buckets, ["rule_type", "_bucket"])
    stream_time = F.greatest(F.col("_prior"), F.col("_inb"))
    closes = shift_micros(F.col("window_end"), grace * 1_000_000)
    return (rows.withColumn("stream_time", stream_time)
            .withColumn("late", F.coalesce(closes <= F.col("stream_time"), F.lit(False))))


def _closings(activity: DataFrame, rules) -> DataFrame:
    """(rule_type, window, closed): the first arrival of an event that closes the window, null for one that none closes.

    ``window`` counts windows from the epoch.  An event closes the windows that end, with their grace, at its ``occurred_at`` or
    before; each is counted at the last of these, and a running minimum from the last window to the first gives it to the others.
    """
    width, grace = _per_rule(rules, "window_seconds") * 1_000_000, _per_rule(rules, "grace_seconds") * 1_000_000
    at = epoch_micros(F.col("occurred_at"))
    arr = arrival()
    marks = F.array(F.struct((F.floor((at - grace) / width) - 1).alias("window"), arr.alias("arr")),
                    F.struct(F.floor(at / width).alias("window"), F.when(F.lit(False), arr).alias("arr")))
    later = Window.partitionBy("rule_type").orderBy(F.desc("window")).rowsBetween(Window.unboundedPreceding, 0)
    return (activity.select("rule_type", F.explode(marks).alias("m")).groupBy(F.col("m.window").alias("window"), "rule_type")
            .agg(F.min("m.arr").alias("_first")).select("rule_type", "window", F.min("_first").over(later).alias("closed")))


def on_time(activity: DataFrame, rules: Iterable[RuleConfig] = DEFAULT_RULES, bucket_seconds: int = 1) -> DataFrame:
    """The activity rows a streaming rule takes: all but W9's.

    A row is late when an event of its rule that closes its window arrived before it.  The closings are one row per rule
    and window, so the rows stay where they are; ``bucket_seconds`` (of W9's stream time) makes no difference here.
    """
    rules = tuple(rules)
    width = _per_rule(rules, "window_seconds") * 1_000_000
    closings = kept(_closings(activity, rules), "rule-closings").withColumnsRenamed({"rule_type": "_rule", "window": "_window"})
    late = F.coalesce(F.col("closed") < arrival(), F.lit(False))
    return (activity.join(closings, (F.col("rule_type") == F.col("_rule")) & (F.floor(epoch_micros(F.col("occurred_at")) / width) == F.col("_window")))
            .where(~late).select(*activity.columns))


def late_events(activity: DataFrame, rules: Iterable[RuleConfig] = DEFAULT_RULES,
                bucket_seconds: int = 1) -> DataFrame:
    """Rows a streaming rule drops because their window had closed."""
    return (_with_stream_time(activity, tuple(rules), bucket_seconds).where(F.col("late"))
            .select("rule_type", "key", "currency", "window_start", "window_end",
                    "event_id", "transaction_id", "occurred_at", "ingested_at", "stream_time"))


def evidence_accounts(cands: DataFrame) -> DataFrame:
    """W10 from candidates: one row per (candidate, involved account)."""
    return cands.select("deduplication_key", F.explode("involved_accounts").alias("account_id"))


def evidence_transactions(cands: DataFrame) -> DataFrame:
    """W10 from candidates: one row per (candidate, transaction)."""
    return cands.select("deduplication_key", F.explode("transaction_ids").alias("transaction_id"))
