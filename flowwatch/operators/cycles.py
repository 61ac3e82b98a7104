"""Bounded, time-ordered money cycles, searched from both ends.

For every validated transaction ``s -> d`` (the candidate, amount ``x`` at time
``t``) find simple paths ``d -> ... -> s`` of 1..max_depth-1 edges where every
edge has ``latest_occurred_at`` in ``[t - window, t]``, a *total* amount in
``x -/+ x*tol div 100``, and edge times do not decrease along the path.
Currency is not compared; parallel currency edges give separate paths.

``as of arrival`` (C1) reads each edge as it stood when the candidate arrived:
the version whose ``(valid_from, valid_to]`` holds the candidate's arrival.
``snapshot`` (C2) reads the final graph.

Scale:

* *Meet in the middle.*  A frontier row holds the two open ends of a path.  Each step extends the end at which
  fewer edges hang (the tail by its out-edges, the head by its in-edges).  A path is complete when one edge joins both ends; where a row
  may grow, the join that makes it longer finds that edge as well, and only the longest paths need an equi-join on two accounts.  So a payment into a hub is searched from the payer, not through all the
  hub's payees.  The choice is a function of the ends, so every path comes out exactly once.
* *Keys.*  Every join is on ``(account, time bucket, amount band, arrival level, arrival slot)``.  A join's band is four
  tolerances wide, so a frontier row needs mostly one, at most two.  Edge versions have
  an arrival level by their lifetime: slots of level ``l`` are as long as the versions in it live at most, so a version lies in
  two slots at most, and of a busy edge's many versions a row meets only those that were valid around its
  arrival.  Each level's slots are 16 times as long as those of the one below.  A row looks up the levels that occur at its
  open end (at both, where it closes).  Versions that outlive a window, and final edges, are keyed by time buckets of two windows instead.
* *Rows* carry only what later joins and the paths read, and ids as 16 bytes where all of them are canonical UUIDs.
* *Trimming (C4)* removes edges and candidates that no cycle can use, before the search, round by round.  Neighbours are
  looked up as bands set in a bit mask, one row per account and time bucket.
"""

from __future__ import annotations

import math
from contextlib import nullcontext
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwatch.config import CIRCULAR_FLOW, DEFAULT_CYCLE, CycleConfig
from flowwatch.functions import arrival, all_canonical, epoch_micros, epoch_seconds, name_uuid, pack_uuid, shift_micros, unpack_uuid
from flowwatch.operators import graph
from flowwatch.operators.activity import graph_updates, packed_events
from flowwatch.operators.alerts import OPEN
from flowwatch.session import is_kept, kept, release, scratch

PATH_OUT = ["cand_event_id", "cand_ingested_at", "cand_transaction_id", "primary_account_id", "depth",
            "path_accounts", "path_transactions", "path_currencies"]


def _band(amount: Column, cfg: CycleConfig) -> Column:
    """Logarithmic amount band; a candidate's whole tolerance spans two bands (more only from 60 percent on)."""
    tol = min(cfg.tolerance_percent, 60)
    width = math.log(max(1.02, (100 + tol) / (100 - tol)))
    return F.floor(F.log(F.greatest(amount.cast("double"), F.lit(1.0))) / F.lit(width)).cast("int")


def cycle_candidates(events: DataFrame, cfg: CycleConfig = DEFAULT_CYCLE) -> DataFrame:
    """Every validated event searched as a closing edge (replays search again)."""
    # whole units, truncated; wide enough for any bigint amount, whose bounds lie outside bigint
    x = F.col("amount_minor").cast("decimal(38,0)")
    slack = F.expr(f"CAST(floor(CAST(abs(CAST(amount_minor AS DECIMAL(20,0))) * {int(cfg.tolerance_percent)} AS DECIMAL(38,0)) / 100) AS DECIMAL(38,0))")
    bucket_us = cfg.window_seconds * 1_000_000
    tmin = shift_micros(F.col("occurred_at"), F.lit(-bucket_us))
    return events.select(
        F.col("event_id").alias("cand_event_id"), F.col("ingested_at").alias("cand_ingested_at"),
        F.col("transaction_id").alias("cand_transaction_id"),
        F.col("source_account_id").alias("cs"), F.col("destination_account_id").alias("cd"),
        F.col("occurred_at").alias("t"), tmin.alias("tmin"),
        (x - slack).alias("lo"), (x + slack).alias("hi"),
        arrival().alias("arr"),
        F.sequence(_band(x - slack, cfg), _band(x + slack, cfg)).alias("bands"))


#: Length of an arrival slot of the first level; a level's slots are 2 ** _STEP times as long as those of the one below.
_SLOT_US, _STEP = 1_000_000, 4
#: Windows in a time bucket and bands in a wide band of the joins.
_WINDOWS, _BANDS = 2, 4
#: Level of versions that live longer than a window, the current ones among them.
_LONG = 0


def _slot_width(level: str) -> Column:
    return F.expr(f"shiftleft({_SLOT_US}L, {_STEP} * ({level} - 1))")


def _wide(band: Column) -> Column:
    return F.floor(band / _BANDS).cast("int")


def edge_view(edge_df: DataFrame, cfg: CycleConfig, as_of: bool) -> DataFrame:
    """Edges (or edge versions) with the columns the hops need, once per arrival slot."""
    bucket_us = cfg.window_seconds * 1_000_000
    cols = [F.col("src").alias("e_src"), F.col("dst").alias("e_dst"), F.col("currency").alias("e_cur"),
            F.col("total_amount_minor").alias("e_total"), F.col("latest_occurred_at").alias("e_occ"),
            F.col("latest_transaction_id").alias("e_tx"),
            F.floor(epoch_seconds(F.col("latest_occurred_at")) / (_WINDOWS * cfg.window_seconds)).alias("e_bucket"),
            _wide(_band(F.col("total_amount_minor"), cfg)).alias("e_band")]
    if not as_of:
        return edge_df.select(*cols, F.lit(_LONG).alias("e_level"), F.lit(0).cast("long").alias("e_slot"))
    start, end = epoch_micros(F.col("valid_from.ts")), epoch_micros(F.col("valid_to.ts"))
    life = end - start
    step = F.greatest(F.ceil(F.log2(F.greatest(life, F.lit(1)) / _SLOT_US) / _STEP), F.lit(0)).cast("int") + 1
    level = F.when(life <= bucket_us, step).otherwise(F.lit(_LONG))             # a current version has no end
    width = _slot_width("e_level")
    slots = F.when(F.col("e_level") > _LONG, F.sequence(F.floor(F.col("_start") / width), F.floor(F.col("_end") / width))).otherwise(
        F.array(F.lit(0).cast("long")))
    return (edge_df.select(*cols, F.col("valid_from").alias("e_vf"), F.col("valid_to").alias("e_vt"),
                           level.alias("e_level"), start.alias("_start"), end.alias("_end"))
            .withColumn("e_slot", F.explode(slots)).drop("_start", "_end")
            .withColumn("e_bucket", F.when(F.col("e_level") == _LONG, F.col("e_bucket")).otherwise(F.lit(0).cast("long"))))


def with_degrees(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges with what hangs at both their ends, out-edges per account, in-edges per account): number and arrival levels."""
    def hanging(end: str, name: str) -> DataFrame:
        return edges.groupBy(F.col(end).alias("_at")).agg(
            F.count(F.lit(1)).alias(f"{name}_count"), F.collect_set("e_level").alias(f"{name}_levels"))

    out, into = hanging("e_src", "e_out"), hanging("e_dst", "e_in")
    both = (edges.join(out, F.col("e_dst") == F.col("_at"), "left").drop("_at")
            .join(into, F.col("e_src") == F.col("_at"), "left").drop("_at"))
    return both, out, into


#: Bands in one bit mask of the trimming.
_WORD = 60


def trim(edge_df: DataFrame, cands: DataFrame, cfg: CycleConfig, max_rounds: int = 8, min_gain: float = 0.0,
         materialize: bool = True) -> tuple[DataFrame, DataFrame]:
    """C4: (edges, candidates) without those that no cycle can use, by rounds to a fixed point.

    Of edges and candidates only distinct (account, account, time bucket, amount band) rows take part.  In a cycle an edge
    is preceded by an edge into its source (or follows the candidate) and followed by one out of its destination (or closes
    at the candidate's source); neighbours lie at most a window apart and in bands that one candidate's tolerance
    spans, which are two, or three where rounding falls on a border.  Rows that lack a neighbour go, which may leave others without; a round that removes
    no more than ``min_gain`` of them is the last.  No cycle is lost, however many rounds run.
    """
    banded = cfg.tolerance_percent <= 60                       # beyond, a candidate's bands are not bounded
    span = [0, 1, 2] if banded else [0]
    band = (lambda c: c) if banded else (lambda c: F.lit(0))
    edge_key = [F.col("src"), F.col("dst"), F.floor(epoch_seconds(F.col("latest_occurred_at")) / cfg.window_seconds).alias("bucket"),
                band(_band(F.col("total_amount_minor"), cfg)).alias("band")]
    now = F.floor(epoch_seconds(F.col("t")) / cfg.window_seconds).alias("bucket")
    of = cands.select(F.col("cs").alias("src"), F.col("cd").alias("dst"), now,
                      (F.get("bands", F.lit(0)) if banded else F.lit(0)).alias("band"))
    rows = edge_df.select(F.lit(True).alias("edge"), *edge_key).union(of.select(F.lit(False), "*")).distinct()

    wide, back = sorted({j - k for j in span for k in span}), [-k for k in span]
    at = F.col("band") + 2                                      # a neighbour's band differs by 2 at most: places from 0

    def mask(spread: list[int]) -> Column:
        """The bands of ``spread`` around a row's own that lie in the word ``_word``, as bits."""
        bits = [F.when(F.floor((at + k) / _WORD) == F.col("_word"), F.expr(f"shiftleft(1L, cast(pmod(band + 2 + {k}, {_WORD}) as int))"))
                .otherwise(F.lit(0).cast("long")) for k in spread]
        return reduce(lambda x, y: x.bitwiseOR(y), bits)

    def neighbours(frame: DataFrame, node: str) -> DataFrame:
        """Per account, bucket and word of bands: bands in which an edge, and in which a candidate, finds a neighbour at its
        destination (``node`` src) or at its source (dst).  An edge is followed in its own bucket or the next; it closes at, and
        follows, candidates of its bucket or the next."""
        none = F.lit(0).cast("long")
        of_edge = [(-1, "_wide", None), (0, "_wide", "_back"), (1, None, "_back")] if node == "src" else [(0, "_wide", "_back"), (1, "_wide", "_back")]
        of_cand = [(-1, "_span", None), (0, "_span", None)]
        offers = [F.array(*[F.struct((F.col("bucket") + d).alias("bucket"), (F.col(e) if e else none).alias("edges"),
                                     (F.col(c) if c else none).alias("cands")) for d, e, c in kinds]) for kinds in (of_edge, of_cand)]
        return (frame.withColumn("_word", F.explode(F.array_distinct(F.array(*[F.floor((at + k) / _WORD) for k in (-2, 2)]))))
                .withColumns({"_wide": mask(wide), "_back": mask(back), "_span": mask(span)})
                .select(F.col(node).alias("_node"), "_word", F.explode(F.when(F.col("edge"), offers[0]).otherwise(offers[1])).alias("_o"))
                .groupBy("_node", F.col("_o.bucket").alias("_bucket"), "_word")
                .agg(F.bit_or("_o.edges").alias("_edges"), F.bit_or("_o.cands").alias("_cands")))

    def with_neighbours(frame: DataFrame) -> DataFrame:
        found = frame
        for node, other in (("dst", "src"), ("src", "dst")):
            fits = F.when(F.col("edge"), F.col("_edges")).otherwise(F.col("_cands"))
            bit = F.expr(f"shiftleft(1L, cast(pmod(band + 2, {_WORD}) as int))")
            found = found.join(neighbours(frame, other), (F.col(node) == F.col("_node")) & (F.col("bucket") == F.col("_bucket"))
                               & (F.floor(at / _WORD) == F.col("_word")) & (fits.bitwiseAND(bit) != 0), "left_semi")
        return found

    rows = _materialize(rows, materialize)
    left = rows.count() if materialize else None
    for _ in range(max_rounds if materialize else 1):
        earlier, rows = rows, _materialize(with_neighbours(rows), materialize)
        if not materialize:
            break
        before, left = left, rows.count()
        release(earlier)
        if before - left <= min_gain * before:
            break
    e = rows.where("edge").select("src", "dst", "bucket", "band").distinct()
    c = rows.where("not edge").select(F.col("src").alias("cs"), F.col("dst").alias("cd"), "bucket", "band")
    lowest = F.get("bands", F.lit(0)) if banded else F.lit(0)
    edges = (edge_df.withColumns({"bucket": edge_key[2], "band": edge_key[3]})
             .join(e, ["src", "dst", "bucket", "band"], "left_semi").select(*edge_df.columns))
    return edges, (cands.withColumn("bucket", now).withColumn("band", lowest)
                   .join(c, ["cs", "cd", "bucket", "band"], "left_semi").select(*cands.columns))


def prefilter(edge_df: DataFrame, events: DataFrame, cfg: CycleConfig = DEFAULT_CYCLE, max_rounds: int = 8) -> DataFrame:
    """C4: the edges that ``trim`` keeps, with every event as a candidate."""
    edge_df = kept(edge_df, "cycle")
    cands = cycle_candidates(events, cfg)
    uuids = _uuids(edge_df, cands)
    packed, cands = _packed(edge_df, cands, uuids)
    return _unpacked(trim(packed, cands, cfg, max_rounds)[0], uuids).select(*edge_df.columns)


#: Columns of edges (or versions) and of candidates that hold ids, by kind of id.
_IDS = {"account": (["src", "dst"], ["cs", "cd"]), "transaction": (["latest_transaction_id"], ["cand_transaction_id"]),
        "event": (["valid_from.id", "valid_to.id"], ["arr.id"])}


def _uuids(edge_df: DataFrame, cands: DataFrame) -> list[str]:
    """Kinds of id of which every one is a canonical lower-case UUID."""
    fine = {kind: True for kind in _IDS}
    for side, frame in enumerate((edge_df, cands)):
        row = frame.agg(*[all_canonical([F.col(c) for c in columns[side] if c.split(".")[0] in frame.columns]).alias(kind)
                          for kind, columns in _IDS.items()]).first()
        fine = {kind: ok and row[kind] is not False for kind, ok in fine.items()}
    return [kind for kind, ok in fine.items() if ok]


def _changed(frame: DataFrame, columns: list[str], change) -> DataFrame:
    for c in columns:
        name, _, field = c.partition(".")
        if name in frame.columns:
            frame = frame.withColumn(name, F.when(F.col(name).isNotNull(), F.struct(F.col(f"{name}.ts").alias("ts"), change(F.col(c)).alias("id")))
                                     if field else change(F.col(name)))
    return frame


def _packed(edge_df: DataFrame, cands: DataFrame, uuids: list[str]) -> tuple[DataFrame, DataFrame]:
    """Edges and candidates with the ids of these kinds as bytes, in the order of the texts."""
    for kind in uuids:
        edge_df, cands = _changed(edge_df, _IDS[kind][0], pack_uuid), _changed(cands, _IDS[kind][1], pack_uuid)
    return edge_df, cands


def _unpacked(edge_df: DataFrame, uuids: list[str]) -> DataFrame:
    for kind in uuids:
        edge_df = _changed(edge_df, _IDS[kind][0], unpack_uuid)
    return edge_df


_PATH = ["nodes", "back_nodes", "txs", "back_txs", "curs", "back_curs"]


def _open_ends(cands: DataFrame, out: DataFrame, into: DataFrame) -> DataFrame:
    """Frontier rows of the candidates: both ends open, nothing between them; candidates with an end without edges go."""
    types = dict(cands.dtypes)
    empty = {"nodes": types["cd"], "txs": types["cand_transaction_id"], "curs": "string"}
    return (cands.join(out, F.col("cd") == F.col("_at")).drop("_at").join(into, F.col("cs") == F.col("_at")).drop("_at")
            .select("cand_transaction_id", "cs", "cd", "lo", "hi", "arr",
                    F.array_distinct(F.transform("bands", _wide)).alias("bands"),
                    F.col("cd").alias("tail"), F.col("e_out_count").alias("tail_count"), F.col("e_out_levels").alias("tail_levels"),
                    F.col("cs").alias("head"), F.col("e_in_count").alias("head_count"), F.col("e_in_levels").alias("head_levels"),
                    *[F.array().cast(f"array<{empty[c.removeprefix('back_')]}>").alias(c) for c in _PATH],
                    F.col("tmin").alias("prev_occ"), F.col("t").alias("next_occ")))


#: The ends that an edge is joined on: behind the tail, before the head, between both.
_TAIL, _HEAD = ("tail", "e_src"), ("head", "e_dst")
_AHEAD, _BACK, _BETWEEN = [_TAIL], [_HEAD], [_TAIL, _HEAD]


def _key(ends: list[tuple[str, str]], side: int, rest: list[str]) -> Column:
    """Hash of a join's key; ``side`` 0 reads it from the frontier, 1 from the edges."""
    kind = "".join(e[0] for e in ends)
    return F.xxhash64(F.lit(kind), *[F.col(e[side]) for e in ends], *[F.col(c).cast("long") for c in rest])


def _edge_keys(edges: DataFrame, as_of: bool) -> DataFrame:
    """The distinct keys under which edges can be met."""
    rest = ["e_bucket", "e_band"] + (["e_level", "e_slot"] if as_of else [])
    return edges.select(F.explode(F.array(*[_key(ends, 1, rest) for ends in (_AHEAD, _BACK, _BETWEEN)])).alias("_k")).distinct()


def _copies(frontier: DataFrame, cfg: CycleConfig, as_of: bool, ends: list[tuple[str, str]]) -> DataFrame:
    """Frontier rows once per key (time bucket ``_b``, band ``_a`` and, ``as_of``, level ``_l`` and slot ``_s``) that edges at ``ends`` may have,
    with its hash ``_k``."""
    seconds = _WINDOWS * cfg.window_seconds
    levels = F.array_intersect("tail_levels", "head_levels") if len(ends) == 2 else F.col(f"{ends[0][0]}_levels")
    p = frontier.withColumns({"_when": F.sequence(F.floor(epoch_seconds(F.col("prev_occ")) / seconds), F.floor(epoch_seconds(F.col("next_occ")) / seconds)),
                              "_arrived": epoch_seconds(F.col("arr.ts"))})               # once per row, not per copy
    p, when = p.withColumn("_a", F.explode("bands")), F.col("_when")
    if as_of:
        slot = F.when(F.col("_l") == _LONG, F.lit(0).cast("long")).otherwise(F.floor(F.col("_arrived") / (_slot_width("_l") / 1_000_000)))
        p = p.withColumn("_l", F.explode(levels)).withColumn("_s", slot)
        when = F.when(F.col("_l") == _LONG, when).otherwise(F.array(F.lit(0).cast("long")))
    return p.withColumn("_b", F.explode(when)).drop("_when", "_arrived").withColumn("_k", _key(ends, 0, ["_b", "_a"] + (["_l", "_s"] if as_of else [])))


def _at_tail() -> Column:
    return F.col("tail_count") <= F.col("head_count")


def _met(parts: list[DataFrame], keys: DataFrame, cfg: CycleConfig, as_of: bool, grows: bool, outlive: bool = False) -> DataFrame:
    """Frontier rows with ``_keys``, the hashes of those of their keys that some edge has; rows without any go.

    Most keys of a row have no edge.  Only (row, hash) pairs are moved to find out which, and the joins then copy a row for the
    others alone; they compare the keys themselves.  Rows that grow meet the edges at their lighter end, those that do not (``grows`` is
    off) the edges between both.  Parts that are written already have their row numbers in ``_f``.
    """
    parts = [part if "_f" in part.columns else kept(part.withColumn("_f", F.monotonically_increasing_id() * len(parts) + n), "cycle")
             for n, part in enumerate(parts)]
    frontier = reduce(DataFrame.union, parts)
    if grows:
        uses = [_copies(frontier.where(_at_tail()), cfg, as_of, _AHEAD), _copies(frontier.where(~_at_tail()), cfg, as_of, _BACK)]
    else:
        uses = [_copies(frontier, cfg, as_of, _BETWEEN)]
    hits = (reduce(DataFrame.union, [u.select("_f", "_k") for u in uses]).join(keys, "_k", "left_semi")
            .groupBy("_f").agg(F.collect_set("_k").alias("_keys")))
    met = kept(frontier.join(hits, "_f").drop("_f"), "cycle", outlive)
    for part in parts:
        release(part)
    return met


def _meeting(frontier: DataFrame, edges: DataFrame, cfg: CycleConfig, as_of: bool, ends: list[tuple[str, str]]) -> DataFrame:
    """Frontier rows with every edge that fits between their ends: joined on ``ends`` and on time bucket, band and arrival slot."""
    p = _copies(frontier, cfg, as_of, ends)
    if "_keys" in p.columns:
        p = p.where(F.array_contains("_keys", F.col("_k"))).drop("_keys")
    cond = [F.col(a) == F.col(b) for a, b in ends] + [F.col("_b") == F.col("e_bucket"), F.col("_a") == F.col("e_band")]
    if as_of:
        cond += [F.col("_l") == F.col("e_level"), F.col("_s") == F.col("e_slot")]
    keep = ((F.col("e_total") >= F.col("lo")) & (F.col("e_total") <= F.col("hi"))
            & (F.col("e_occ") >= F.col("prev_occ")) & (F.col("e_occ") <= F.col("next_occ")))
    if as_of:
        keep = keep & (F.col("e_vf") < F.col("arr")) & (F.col("e_vt").isNull() | (F.col("arr") <= F.col("e_vt")))
    return p.join(edges, cond).where(keep).drop("_b", "_a", "_l", "_s", "_k")


def _new(node: str) -> Column:
    return (F.col(node) != F.col("cs")) & (F.col(node) != F.col("cd")) & ~F.array_contains("nodes", F.col(node)) & ~F.array_contains("back_nodes", F.col(node))


def _longer(frontier: DataFrame, edges: DataFrame, cfg: CycleConfig, as_of: bool) -> DataFrame:
    """Frontier rows one edge longer, each at its lighter end; of those that ``closes`` marks the edge ends at the other end, which makes
    their paths complete, so they have no new node."""
    columns = [c for c in frontier.columns if c != "_keys"] + ["closes"]
    closes = F.col("closes")
    ahead = (_meeting(frontier.where(_at_tail()), edges, cfg, as_of, _AHEAD).withColumn("closes", F.col("e_dst") == F.col("head"))
             .where(closes | (_new("e_dst") & F.col("e_out_count").isNotNull()))
             .withColumns({"nodes": F.when(closes, F.col("nodes")).otherwise(F.concat("nodes", F.array("e_dst"))),
                           "txs": F.concat("txs", F.array("e_tx")),
                           "curs": F.concat("curs", F.array("e_cur")), "prev_occ": F.col("e_occ"), "tail": F.col("e_dst"),
                           "tail_count": F.col("e_out_count"), "tail_levels": F.col("e_out_levels")}))
    back = (_meeting(frontier.where(~_at_tail()), edges, cfg, as_of, _BACK).withColumn("closes", F.col("e_src") == F.col("tail"))
            .where(closes | (_new("e_src") & F.col("e_in_count").isNotNull()))
            .withColumns({"back_nodes": F.when(closes, F.col("back_nodes")).otherwise(F.concat(F.array("e_src"), "back_nodes")),
                          "back_txs": F.concat(F.array("e_tx"), "back_txs"),
                          "back_curs": F.concat(F.array("e_cur"), "back_curs"), "next_occ": F.col("e_occ"), "head": F.col("e_src"),
                          "head_count": F.col("e_in_count"), "head_levels": F.col("e_in_levels")}))
    return ahead.select(*columns).union(back.select(*columns))


def _grown_parts(longer: DataFrame) -> list[DataFrame]:
    """What is still open of the rows that ``_longer`` gives."""
    return [longer.where(~F.col("closes")).drop("closes")]


def _grown(frontier: DataFrame, edges: DataFrame, cfg: CycleConfig, as_of: bool) -> DataFrame:
    """Frontier rows one edge longer, each at its lighter end, that are still open."""
    return reduce(DataFrame.union, _grown_parts(_longer(frontier, edges, cfg, as_of)))


def _start(cands: DataFrame, edges: DataFrame, out: DataFrame, into: DataFrame, cfg: CycleConfig, as_of: bool,
           materialize: bool) -> tuple[DataFrame, DataFrame | None]:
    """(frontier of the candidates, keys of the edges); ``edges``, ``out`` and ``into`` as ``with_degrees`` gives them.

    Written, both outlive the scope in which they are made, and with it what only they are made of.
    """
    ends = _open_ends(cands, out, into)
    if not materialize:
        return ends, None
    keys = kept(_edge_keys(edges, as_of), "cycle", outlive=True)
    return _met([ends], keys, cfg, as_of, cfg.max_depth > 2, outlive=True), keys


def find_paths(frontier: DataFrame, keys: DataFrame | None, edges: DataFrame, cfg: CycleConfig, as_of: bool) -> DataFrame:
    """All qualifying paths, union over 1..max_depth-1 edges; ``frontier`` and ``keys`` as ``_start`` gives them.

    One join at the lighter end finds the edges that close a frontier row as well as those that make it longer; what it gives is
    written once.  Only rows that may not grow any more are joined between both ends.  The paths of each length are
    written, too, so that the shuffles of one length are gone before those of the next.
    """
    materialize = keys is not None

    def met(parts: list[DataFrame], depth: int) -> DataFrame:
        return _met(parts, keys, cfg, as_of, depth < cfg.max_depth - 1) if materialize else reduce(DataFrame.union, parts)

    found = None
    for depth in range(1, cfg.max_depth):
        shorter, grows = frontier, depth < cfg.max_depth - 1
        longer = _longer(shorter, edges, cfg, as_of) if grows else None
        if grows and materialize:
            longer = kept(longer.withColumn("_f", F.monotonically_increasing_id()), "cycle")
            release(shorter)
            whole = longer.where("closes")
        else:                                                        # unwritten, the join behind both would run for each
            whole = _meeting(shorter, edges, cfg, as_of, _BETWEEN).withColumns(
                {"txs": F.concat("txs", F.array("e_tx")), "curs": F.concat("curs", F.array("e_cur"))})
        closed = whole.select(
            F.col("arr.id").alias("cand_event_id"), F.col("arr.ts").alias("cand_ingested_at"), "cand_transaction_id",
            F.col("cs").alias("primary_account_id"),
            F.lit(depth).alias("depth"),
            F.concat(F.array("cd"), "nodes", "back_nodes", F.array("cs")).alias("path_accounts"),
            F.concat("txs", "back_txs").alias("path_transactions"),
            F.concat("curs", "back_curs").alias("path_currencies"))
        closed = kept(closed, "cycle-paths", outlive=True) if materialize else closed
        found = closed if found is None else found.unionByName(closed)
        if grows:
            frontier = met(_grown_parts(longer), depth + 1)
            release(longer)
    return found


def _materialize(df: DataFrame, enabled: bool, name: str = "cycle") -> DataFrame:
    """Written once where several joins read it."""
    return kept(df, name) if enabled and not is_kept(df) else df


#: Trimming rounds inside the search: a further one has to be worth its two shuffles.
_ROUNDS, _WORTH = 3, 0.1


def search(candidates: DataFrame, edge_df: DataFrame, cfg: CycleConfig = DEFAULT_CYCLE, as_of: bool = True,
           prefilter_edges: bool = True, materialize: bool = True, packed: list[str] | None = None) -> DataFrame:
    """Paths that events close over edge versions (or, not ``as_of``, over edges).

    ``packed`` names the kinds of id that both hold as bytes already.  Of what is written on the way only the paths outlive the search.
    """
    cands = cycle_candidates(candidates, cfg)
    uuids, whole = packed or [], None
    scope = scratch if materialize else nullcontext
    with scope():
        with scope():                                                # what trimming keeps goes before the frontiers grow
            if prefilter_edges:
                edge_df = whole = _materialize(edge_df, materialize)
                if packed is None and materialize:
                    uuids = _uuids(edge_df, cands)
                    edge_df, cands = _packed(edge_df, cands, uuids)
                edge_df, cands = trim(edge_df, cands, cfg, _ROUNDS, _WORTH, materialize)
            view = _materialize(edge_view(edge_df, cfg, as_of), materialize)
            release(whole)
            edges, out, into = with_degrees(view)
            edges = kept(edges, "cycle", outlive=True) if materialize else edges
            frontier, keys = _start(cands, edges, out, into, cfg, as_of, materialize)
        found = find_paths(frontier, keys, edges, cfg, as_of)
    for kind, columns in {"account": ["primary_account_id", "path_accounts"], "transaction": ["cand_transaction_id", "path_transactions"],
                          "event": ["cand_event_id"]}.items():
        if kind in uuids:
            found = found.withColumns({c: F.transform(c, unpack_uuid) if c.startswith("path") else unpack_uuid(F.col(c)) for c in columns})
    return found


def circular_flow(events: DataFrame, cfg: CycleConfig = DEFAULT_CYCLE, prefilter_edges: bool = True,
                  materialize: bool = True, packed: list[str] | None = None) -> DataFrame:
    """Paths over the graph as of each candidate's arrival (strictly before).  ``packed`` names the kinds of id that the events
    hold as bytes already."""
    uuids = packed or []
    if packed is None and materialize:
        events, uuids = packed_events(events)
    with scratch() if materialize else nullcontext():
        versions = graph.edge_versions(graph.processed(graph_updates(events), graph.EDGE_EVENT), keep=lambda df: _materialize(df, materialize))
        if materialize:
            versions = kept(versions, "cycle", outlive=True)
    return search(events, versions, cfg, True, prefilter_edges, materialize, uuids)


def circular_flow_snapshot(events: DataFrame, cfg: CycleConfig = DEFAULT_CYCLE,
                           prefilter_edges: bool = True, materialize: bool = True) -> DataFrame:
    """Paths over the final graph."""
    events, uuids = packed_events(events) if materialize else (events, [])
    final = graph.edges(graph.processed(graph_updates(events), graph.EDGE_EVENT))
    return search(events, final, cfg, False, prefilter_edges, materialize, uuids)


def circular_alerts(paths: DataFrame) -> DataFrame:
    """One alert event per path.

    Key = ``CIRCULAR_FLOW_`` + sorted path accounts joined by ``_`` (no window,
    either direction).  Alert id is deterministic per emission (candidate event,
    arrival and path), so later emissions of a key count as duplicates.
    """
    key = F.concat(F.lit(CIRCULAR_FLOW + "_"), F.array_join(F.sort_array("path_accounts"), "_"))
    emission = F.concat_ws("|", key, F.col("cand_event_id"), epoch_micros(F.col("cand_ingested_at")).cast("string"),
                           F.array_join("path_transactions", ","), F.array_join("path_currencies", ","))
    return paths.select(
        name_uuid(emission).alias("alert_id"),
        key.alias("deduplication_key"),
        F.lit(CIRCULAR_FLOW).alias("rule_type"),
        F.col("primary_account_id"),
        F.lit(OPEN).alias("status"),
        F.sort_array(F.array_distinct("path_accounts")).alias("involved_accounts"),
        F.array_sort(F.array_distinct(F.concat("path_transactions", F.array("cand_transaction_id"))))
        .alias("transaction_ids"),
        F.col("cand_ingested_at").alias("generated_at"),
        F.col("cand_event_id").alias("trigger_event_id"))
