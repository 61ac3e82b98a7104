"""Operator 4: mix sources to target weights with a low-discrepancy source schedule (DataFrame functions only).

The mix is a line of slots, whose number grows with the corpus.  Slot i sits at the golden-ratio point frac(i * phi), which the
cumulative target shares map to a source, so every stretch of the schedule already holds the target
mix.  A source's slots are ranked in schedule order; its documents, shuffled by a hash of their id, are cut into
equal-token blocks (of about a slot's words, smaller in a small source, which has more slots for it), and the
slot of rank r takes block r mod (number of blocks).  Ranks and positions are two-level prefix sums, so
a source that holds a third of all words is not ranked in one task.

Defined results: null text has size 0; documents of size 0 are returned with taken 0; a null source is a
source of its own, ordered last; repeated rows (also of one doc_id) each take part as rows of their own; an empty
table gives no rows.  Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

#: Fixed values of the schedule: the odd integer nearest to 2^32 / golden ratio, and 2^32.
GOLDEN_STEP, GOLDEN_RANGE = 2654435769, 1 << 32
MAX_REPEATS = 3
#: A mix has at least so many slots, and a slot at most so many words.
SLOTS, SLOT_WORDS = 1 << 16, 1 << 16
#: Blocks of a source at least (or one per word), so that a small source among large ones comes near its target too.
LEAST_BLOCKS = 1 << 10
#: Slots and blocks that one task ranks or adds up.
PAGE = 4096
#: Points and lanes meet in so many equal stretches of the unit interval.
STRETCHES = 4096


def word_count(text) -> F.Column:
    """Words ``[^\\x20\\x09-\\x0D]+``: blank runs become one blank each, then the gaps are counted."""
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    gaps = F.length(line) - F.length(F.replace(line, F.lit(" ")))
    return F.when(line == "", F.lit(0)).otherwise(gaps + 1).cast("long")


def _by_source() -> Window:
    return Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))


def targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> + lane, weight, cap, total, target.  One row per source.

    Weights are 1, 2, 3, 1, ... by source code point, null last.  Water filling: with sources in order of
    cap / weight, the level left to a source by those before it at their caps rises until the first
    source under its cap and falls after it, so the water level is the largest of these levels.
    """
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "lane").rowsBetween(Window.unboundedPreceding, -1)
    return (sizes
            .withColumn("lane", F.row_number().over(_by_source()))
            .withColumn("weight", ((F.col("lane") - 1) % 3 + 1).cast("double"))
            .withColumn("cap", F.col("source_size").cast("double") * max_repeats)
            .withColumn("total", F.sum("source_size").over(everything).cast("double"))
            .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(fill), F.lit(0.0)))
                        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0))))
            .withColumn("target", F.least("cap", F.max("level").over(everything) * F.col("weight")))
            .drop("level"))


def lanes(goal: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Sources with words -> + blocks (equal-token blocks of the source), wanted slots, and the stretch
    [low, high) of the schedule's line that is theirs; ``every`` is the line's length."""
    up_to = Window.orderBy("lane").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slot_words = F.greatest(F.lit(1.0), F.least(F.lit(float(SLOT_WORDS)), F.col("total") / slots))
    least = F.least(F.col("source_size"), F.lit(LEAST_BLOCKS))
    return (goal.where("source_size > 0")
            .withColumn("blocks", F.greatest(least, F.round(F.col("source_size") / slot_words)).cast("long"))
            .withColumn("wanted", F.col("target") * F.col("blocks") / F.col("source_size"))
            .withColumn("high", F.sum("wanted").over(up_to))
            .withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("lane")), F.lit(0.0)))
            .withColumn("every", F.sum("wanted").over(Window.partitionBy())))


def schedule(lane_table: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(slot, lane, rank, block): the low-discrepancy schedule.

    Points and lanes meet by an equi-join on stretches of the line.  Ranks beyond max_repeats rounds of a source are
    left out: rounding must not lift a document above that many copies.
    """
    spread = lane_table.agg(F.ceil(F.max("every")).cast("long").alias("n"), F.max("every").alias("every"))
    points = (spread.where("n > 0")
              .select("every", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PAGE))).alias("page"))
              .select("every", F.explode(F.sequence(F.col("page") * PAGE,
                                                    F.least(F.col("page") * PAGE + PAGE - 1, F.col("n") - 1))).alias("slot"))
              .withColumn("x", (F.col("slot") * GOLDEN_STEP % GOLDEN_RANGE).cast("double") / float(GOLDEN_RANGE) * F.col("every"))
              .withColumn("stretch", F.floor(F.col("x") / F.col("every") * STRETCHES)))
    spans = lane_table.select("lane", "blocks", "low", "high", F.explode(F.sequence(
        F.floor(F.col("low") / F.col("every") * STRETCHES),
        F.floor(F.col("high") / F.col("every") * STRETCHES))).alias("stretch"))
    placed = (points.join(spans, "stretch").where("x >= low and x < high")
              .select("slot", "lane", "blocks", F.floor(F.col("slot") / PAGE).alias("page")))
    pages = placed.groupBy("lane", "page").agg(F.count("*").alias("held")).withColumn("first", _before("held", "page"))
    return (placed.join(pages.select("lane", "page", "first"), ["lane", "page"])
            .withColumn("rank", F.col("first") + F.row_number().over(Window.partitionBy("lane", "page").orderBy("slot")) - 1)
            .where(F.col("rank") < F.col("blocks") * max_repeats)
            .select("slot", "lane", "rank", (F.col("rank") % F.col("blocks")).alias("block")))


def _block_line(lane_table: DataFrame, plan: DataFrame) -> DataFrame:
    """(lane, block, begin, times, before): blocks with their first word, how often the mix takes them, and the words it
    takes from the lane before them."""
    blocks = (lane_table.select("lane", "source_size", "blocks",
                                F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
              .join(plan.groupBy("lane", "block").agg(F.count("*").alias("times")), ["lane", "block"], "left")
              .withColumn("times", F.coalesce("times", F.lit(0)))
              .withColumn("begin", _block_begin("block"))
              .withColumn("words", _block_begin("block + 1") - F.col("begin")))
    blocks = blocks.withColumn("page", F.floor(F.col("block") / PAGE)).withColumn("held", F.col("words") * F.col("times"))
    pages = blocks.groupBy("lane", "page").agg(F.sum("held").alias("held")).withColumn("first", _before("held", "page"))
    return (blocks.join(pages.select("lane", "page", "first"), ["lane", "page"])
            .withColumn("before", F.col("first") + _before("held", "block", "page"))
            .select("lane", "block", "begin", "times", "before"))


def _before(value: str, order: str, *inside: str) -> F.Column:
    """Sum of ``value`` over the rows of the lane (and of ``inside``) that come before this one."""
    back = Window.partitionBy("lane", *inside).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(back), F.lit(0))


def _block_begin(block: str) -> F.Column:
    """Smallest word position p with p * blocks div source_size = block."""
    return F.expr(f"(({block}) * source_size + blocks - 1) div blocks")


def mix(docs: DataFrame, max_repeats: int = MAX_REPEATS, slots: int = SLOTS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``.

    Positions of documents on their source's shuffled line are two-level prefix sums (source and
    hash bucket, then rows inside a bucket), so no task sorts a whole source.  ``taken`` is the difference
    of two prefix lookups on the block line, so long documents need no expansion into blocks.
    """
    ws = Workspace(docs.sparkSession, "mix")
    sized = ws.table(docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("draw"))
        .withColumn("bucket", F.substring("draw", 1, 3)), "sized")
    goal = ws.table(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), max_repeats), "targets")
    lane_table = lanes(goal, slots)
    line = ws.table(_block_line(lane_table, schedule(lane_table, max_repeats)), "blocks")
    known = goal.join(lane_table.select("lane", "blocks"), "lane", "left")
    rows = sized.alias("d").join(
        known.select(F.col("source").alias("of"), "lane", "source_size", "target", "blocks"),
        F.col("d.source").eqNullSafe(F.col("of"))).drop("of")
    in_bucket = Window.partitionBy("lane", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    buckets = (rows.groupBy("lane", "bucket").agg(F.sum("size").alias("held"))
               .withColumn("bucket_begin", F.sum("held").over(
                   Window.partitionBy("lane").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
                   - F.col("held")).drop("held"))
    placed = (rows.join(buckets, ["lane", "bucket"])
              .withColumn("end", F.col("bucket_begin") + F.sum("size").over(in_bucket))
              .withColumn("begin", F.col("end") - F.col("size"))
              .withColumn("block_a", F.when(F.col("size") > 0, F.expr("(begin * blocks) div source_size")))
              .withColumn("block_z", F.when(F.col("size") > 0, F.expr("((end - 1) * blocks) div source_size"))))
    a = line.select("lane", F.col("block").alias("block_a"), F.col("begin").alias("begin_a"),
                    F.col("times").alias("times_a"), F.col("before").alias("before_a"))
    z = line.select("lane", F.col("block").alias("block_z"), F.col("begin").alias("begin_z"),
                    F.col("times").alias("times_z"), F.col("before").alias("before_z"))
    return (placed.join(a, ["lane", "block_a"], "left").join(z, ["lane", "block_z"], "left")
            .withColumn("taken", F.when(F.col("size") == 0, F.lit(0)).otherwise(
                F.expr("before_z + (end - begin_z) * times_z - before_a - (begin - begin_a) * times_a")).cast("long"))
            .select("doc_id", "source", "size", "source_size", "target", "taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix: every row as often as the mix takes it, all columns of ``docs``.

    A document stands round(taken / size) times: a source's blocks are taken in rounds, in order, so its documents
    differ at one place of its line only, and rounding the document there keeps the source near its target.  Documents without words stay once.
    """
    mark = "mix_row_key"
    while mark in docs.columns:
        mark += "_"
    share = (mix(docs).groupBy("doc_id", "source", "size").agg(F.avg("taken").alias("taken")))
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.round(F.col("taken") / F.col("size"))).cast("int")
    counts = share.select(F.struct(F.col("doc_id"), F.col("source"), F.col("size")).alias(mark), times.alias(mark + "n"))
    keyed = docs.withColumn(mark, F.struct(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size")))
    out = keyed.alias("k").join(counts.alias("c"), F.col(f"k.{mark}").eqNullSafe(F.col(f"c.{mark}")))
    return out.select(*[F.col(f"k.`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.when(
        F.col(f"c.{mark}n") > 0, F.col(f"c.{mark}n")))).alias(mark)).drop(mark)
