"""Mixing sources to target weights along a low-discrepancy schedule.

Targets: sources by code point, a null source last, weigh 3, 1, 2, 3, ...; together they get ``share`` of
all words, and a source whose part exceeds ``cap`` times its size stops there while the others share the
excess by weight. The schedule has 2 ** k slots. Slot i's van der Corput point (i's bits reversed) falls
into the stretch of a source on [0, 1), stretches being as long as the sources' parts, so every run of slots
holds the sources near their parts. The r-th slot of a source takes its r-th block: the source's documents
in shuffled order, end to end and again from the start, cut into blocks of equal words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bytes as B
from .store import Store

WEIGHTS = (3, 1, 2)
#: Words that a block has, about, where the schedule is long enough.
BLOCK_WORDS = 4096
#: Slots of a schedule, as powers of two.
LEAST_SLOTS, MOST_SLOTS = 12, 30
#: Parts of the schedule within which running counts are taken; rows of a part of a source's shuffled order, about.
CHUNKS = 256
CHUNK_ROWS = 200_000
#: Cells of [0, 1) by which slots find their source.
CELLS = 12


def word_count(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D; 0 of a null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target) of each source of ``sized`` (source, size). One row for each source.

    With w sorted by cap / weight, sources stop at their caps from the first on until the level that the rest
    would share no longer exceeds the next cap. Sources without words get 0.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (nth % len(weights) + 1).cast("int")))
    per = per.withColumn("weight", F.when(F.col("source_size") > 0, F.col("weight")).otherwise(0.0)).withColumn("most", cap * F.col("source_size"))
    live = F.col("weight") > 0
    order = W.orderBy(F.when(live, F.col("most") / F.col("weight")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    left = share * F.sum("source_size").over(whole) - F.coalesce(F.sum(F.when(live, F.col("most"))).over(before), F.lit(0.0))
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", F.when(live, left / rest))
    per = per.withColumn("nth", F.row_number().over(order))
    holds = F.col("level") * F.col("weight") <= F.col("most") * (1 + 1e-12)
    level = F.min(F.when(holds, F.struct("nth", "level"))).over(whole)["level"]
    return per.withColumn("target", F.when(live, F.least("most", F.coalesce(level * F.col("weight"), F.col("most")))).otherwise(0.0)).select("source", "source_size", "weight", "target")


def schedule(parts: DataFrame, slots: int) -> DataFrame:
    """(source, rank) of each of the 2 ** slots slots. parts: source, first, after (in slots).

    Slots meet sources by equal cells of the unit interval, so no slot is compared with every source.
    """
    low = max(0, slots - CELLS)
    wide = 1 << low
    cells = parts.where("first < after").withColumn("cell", F.explode(F.sequence(F.expr(f"first div {wide}"), F.expr(f"(after - 1) div {wide}"))))
    point = F.conv(F.reverse(F.lpad(F.bin("id"), slots, "0")), 2, 10).cast("long")
    points = parts.sparkSession.range(1 << slots).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.expr(f"point div {wide}"))
    placed = points.join(cells, "cell").where("point >= first and point < after").withColumn("chunk", F.expr(f"slot div {max(1, (1 << slots) // CHUNKS)}"))
    counts = placed.groupBy("sid", "chunk").count()
    base = F.coalesce(F.sum("count").over(W.partitionBy("sid").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("sid", "chunk", base.alias("base"))
    ranked = placed.withColumn("n", F.row_number().over(W.partitionBy("sid", "chunk").orderBy("slot")))
    return ranked.join(bases, ["sid", "chunk"]).select("slot", "sid", (F.col("base") + F.col("n") - 1).alias("block"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 0) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, taken, whole, part, slots.

    taken counts the words the mix takes of the row, repeats included: ``whole`` times the whole text, then
    its words from part.first to part.after. slots has the slot at which each of these times begins: rows in the
    order of their slots are the mix, and each run of slots holds the sources near their parts. A source's taken words differ from its target by less than one.
    No row is taken more than ``cap`` times (cap at most 2). A null or empty text has size 0 and is never taken; a null source
    is a source of its own. Rows that repeat are rows of their own. Reruns agree: shuffling is by a hash
    of id and seed, ties by size. An empty table gives an empty one. No other column is read.
    """
    if not 0 < cap <= 2:
        raise ValueError("cap must be above 0 and at most 2")
    spark = docs.sparkSession
    store = Store(spark, "mixing")
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"))
    sized = store.put(sized.withColumn("h", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(seed))), "sized")
    goals = store.put(targets(sized, weights, share, cap).withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))), "targets")
    total = goals.agg(F.sum("target").alias("t"), F.count("*").alias("n")).first()
    words, sources = float(total["t"] or 0), int(total["n"])
    slots = LEAST_SLOTS
    while slots < MOST_SLOTS and (1 << slots) * BLOCK_WORDS < words or (1 << slots) < 64 * sources:
        slots += 1

    # A source's stretch ends at a slot, and each source with a target has one at least.
    order = W.orderBy("sid")
    live = F.col("target") > 0
    spare = (1 << slots) - F.sum(live.cast("long")).over(W.partitionBy())
    ends = F.floor(F.sum("target").over(order) / F.lit(words or 1.0) * spare + 0.5).cast("long") + F.sum(live.cast("long")).over(order)
    parts = goals.withColumn("after", ends).withColumn("first", F.coalesce(F.lag("after").over(order), F.lit(0)))
    parts = store.put(parts.withColumn("n_slots", F.col("after") - F.col("first")), "parts")

    # Documents' places in their source's shuffled stream of words.
    rows = sized.join(goals.select("source", "sid"), sized["source"].eqNullSafe(goals["source"])).select("doc_id", sized["source"], "size", "h", "sid")
    bits = min(24, max(8, (sized.count() // CHUNK_ROWS).bit_length()))
    rows = rows.withColumn("chunk", F.shiftrightunsigned("h", 64 - bits))
    sums = rows.groupBy("sid", "chunk").agg(F.sum("size").alias("s"))
    base = F.coalesce(F.sum("s").over(W.partitionBy("sid").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("sid", "chunk", base.alias("base"))
    run = F.sum("size").over(W.partitionBy("sid", "chunk").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0))
    placed = rows.withColumn("run", run).join(sums, ["sid", "chunk"]).withColumn("end", F.col("base") + F.col("run")).drop("base", "run", "chunk", "h")
    placed = store.put(placed.withColumn("at", F.col("end") - F.col("size")), "placed")

    # Block b of a source is the words from floor(b * target / n_slots) on of its endless stream.
    facts = parts.select("sid", "source_size", "target", "n_slots")
    cut = lambda b: F.floor(b * F.col("target") / F.col("n_slots")).cast("long")
    pieces = placed.where("size > 0").join(facts, "sid").where("n_slots > 0").withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1))))
    pieces = pieces.withColumn("from", F.col("at") + F.col("turn") * F.col("source_size")).withColumn("to", F.col("from") + F.col("size"))
    near = lambda w: F.floor(w * F.col("n_slots") / F.col("target")).cast("long")
    pieces = pieces.where(F.col("from") < F.col("target")).withColumn("block", F.explode(F.sequence(F.greatest(near(F.col("from")) - 1, F.lit(0)), F.least(near(F.col("to")) + 1, F.col("n_slots") - 1))))
    pieces = pieces.withColumn("words", F.least("to", cut(F.col("block") + 1)) - F.greatest("from", cut(F.col("block")))).where("words > 0")
    begins = F.array_compact(F.array(*(F.min(F.when(F.col("turn") == t, F.struct("block", "slot"))) for t in (0, 1))))
    taken = pieces.join(schedule(parts, slots), ["sid", "block"]).groupBy("sid", "at").agg(F.sum("words").alias("taken"), F.transform(begins, lambda x: x["slot"]).alias("slots"))

    # A place in the stream tells rows with words apart, also where they repeat.
    result = placed.where("size > 0").join(taken, ["sid", "at"], "left").unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")), allowMissingColumns=True)
    result = result.join(goals.select("sid", "source_size", "target"), "sid").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    whole = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(0).cast("long")
    part = F.struct(F.lit(0).cast("long").alias("first"), (F.col("taken") - whole * F.col("size")).alias("after"))
    return result.select("doc_id", "source", "size", "source_size", "target", "taken", whole.alias("whole"), part.alias("part"), F.coalesce("slots", F.array().cast("array<bigint>")).alias("slots"))


def materialize(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as ``plan``, which ``mix`` made of them, takes them.

    A row is given ``whole`` times unchanged, and once more with its text up to the end of the last word
    of its part. Each partition, and so each file that is written, is in the order of the slots, and thus a low-discrepancy
    mix itself. Rows that agree in id, source and size are matched one to one. Rows not taken, those with a null or
    empty text among them, are left out; an empty table gives an empty one. Columns of any name stay as they are.
    """
    columns = docs.columns
    row = F.struct(*(F.col(f"`{c}`") for c in columns))
    key = lambda i, source: [F.coalesce(i, F.lit(-(1 << 62))).alias("id"), F.coalesce(source, F.lit("")).alias("source"), source.isNull().alias("none")]
    on = ["id", "source", "none", "size", "nth"]
    rows = docs.select(*key(F.col(id_col).cast("long"), F.col(source_col).cast("string")), word_count(F.col(text_col).cast("string")).alias("size"), row.alias("row"))
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy(*on[:4]).orderBy(F.lit(0))))
    times = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("whole").cast("int")), F.when(F.col("part.after") > 0, F.array("part.after")).otherwise(F.array().cast("array<bigint>")))
    plan = plan.where("taken > 0").select(*key(F.col("doc_id"), F.col("source")), "size", "taken", F.arrays_zip(times.alias("words"), F.col("slots").alias("slot")).alias("times"))
    # Every row of a key is there with its number, so those without words taken pair with none.
    plan = plan.withColumn("nth", F.row_number().over(W.partitionBy(*on[:4]).orderBy(F.desc("taken"), "times"))).drop("taken")
    taken = rows.join(plan, on).select("row", F.explode("times").alias("time")).sortWithinPartitions("time.slot").select("row.*", F.col("time.words").alias("words"))
    taken = taken.toDF(*(f"c{i}" for i in range(len(columns))), "words")
    at, kind = columns.index(text_col), docs.schema

    def cut(batches):
        for batch in B.slices(batches):
            data, offsets = B.texts_of(batch.column(at))
            words = batch.column(len(columns)).to_numpy()
            texts = batch.column(at).to_pylist()
            for i in np.flatnonzero(words >= 0):
                own = data[offsets[i] : offsets[i + 1]]
                _, end, _ = B.words_of(own, np.array([0, len(own)]))
                texts[i] = own[: end[words[i] - 1]].tobytes().decode()
            cols = [batch.column(i) for i in range(len(columns))]
            cols[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(cols, columns)

    return taken.mapInArrow(B.released(cut), kind)
