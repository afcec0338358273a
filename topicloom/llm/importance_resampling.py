"""Resampling of documents towards a target text by hashed n-gram features.

Plan. The n-gram arrays of a text are exploded and each gram becomes a bucket, crc32 modulo ``buckets``. The
(row, bucket) pairs are written once: beside each other a row's id is a run and buckets come from a small dictionary,
so the table costs some two bytes a gram. Bucket counts of both sides are grouped with map-side sums, and the gain of a
bucket, at most ``buckets`` rows in all, is broadcast to the pairs, which sum up by row. Scores add Gumbel noise
made of the id, so that the highest scores are a draw without replacement. The rows that may be drawn are sorted by
ranges, numbered within each range, and the ranges' sizes give the offsets: no task sees more than a range.

Skew. A frequent gram is one number for each task by the time it moves; a row's pairs are summed where they are
read, however long its text; ranges are cut by score, doc_id and row, of which no value is frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is between words: all of ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Buckets up to which their gains, 16 bytes each, go to every task.
MOST = 1 << 20


def words_of(text: Column) -> Column:
    """Words of a text: runs of code points other than ASCII that is no digit or letter, A to Z in lower case."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def grams_of(words: Column, least: int, most: int) -> Column:
    """All runs of ``least`` to ``most`` words, joined by one space, repeats kept."""
    if least == most == 1:
        return words

    def of(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))

    return F.flatten(F.array(*(of(n) for n in range(least, most + 1))))


def _bucketed(texts: DataFrame, keep: list[str], grams: tuple[int, int], buckets: int) -> DataFrame:
    """``keep``, the number of words and the bucket of each gram; one row with a null bucket where there is none."""
    words = texts.select(*keep, words_of(F.col("text")).alias("words"))
    rows = words.select(*keep, F.size("words").cast("long").alias("n_words"), F.explode_outer(grams_of(F.col("words"), *grams)).alias("gram"))
    return rows.select(*keep, "n_words", F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(buckets)).cast("int").alias("bucket"))


def gains(pool: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of buckets of ``pool(bucket)``: floor(1000 ln) of the smoothed share in the target over that in the pool.

    Null buckets are left out; a bucket that is not in the target counts as 0 there.
    """
    s = pool.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("s"))
    t = target.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("t"))
    counts = s.join(t, "bucket", "left").select("bucket", "s", F.coalesce("t", F.lit(0)).alias("t"))
    all_s, all_t = (float(df.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0]) for df, c in ((s, "s"), (t, "t")))
    up = (F.col("t") + 1).cast("double") * F.lit(all_s + buckets)
    down = (F.col("s") + 1).cast("double") * F.lit(all_t + buckets)
    return counts.select("bucket", F.floor(F.lit(1000.0) * F.log(up / down)).cast("long").alias("gain"))


def _noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, made of the id alone; a null id counts as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    grams: tuple[int, int] = (1, 2), buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_features, weight, score, rank.

    Features are all runs of grams[0] to grams[1] words; weight is the floored mean of their buckets' gains, 0 without features.
    Of the N rows of at least ``least_words`` words, floor(percent * N / 100) are drawn: the highest scores, ties by
    doc_id (nulls last), then in the order they are read. rank counts them from 1 and is null for the others.

    A null or empty text has no words and is never drawn unless least_words is 0. Rows that repeat an id have the same noise and
    are drawn each by itself. An empty table, or percent 0, draws none; an empty target only smooths. ids are integers; other columns are not read.
    """
    store = Store(docs.sparkSession, "resample")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    pairs = store.put(_bucketed(rows, ["row", "doc_id"], grams, buckets), "pairs")
    wanted = store.put(_bucketed(target.select(F.col(f"`{target_col}`").cast("string").alias("text")), [], grams, buckets).select("bucket"), "target")
    gain = store.put(gains(pairs, wanted, buckets), "gains")
    joined = pairs.join(F.broadcast(gain) if buckets <= MOST else gain, "bucket", "left")
    # Keys only, so that sums of fixed width stay in the hash table.
    sums = joined.groupBy("row", "doc_id", "n_words").agg(F.count("bucket").alias("n_features"), F.sum(F.coalesce("gain", F.lit(0))).alias("sum"))
    n = F.greatest("n_features", F.lit(1))
    weight = F.floor((F.col("sum") - F.pmod("sum", n)) / n).cast("long")
    scored = sums.select("row", "doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed))

    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    scored = store.put(scored, "scored")
    able = scored.where(F.col("n_words") >= least_words).orderBy(*order).withColumn("place", F.monotonically_increasing_id())
    able = store.put(able, "sorted").withColumn("range", F.shiftright("place", 33))
    # One row a range; their number is that of the sort's tasks.
    sizes = able.groupBy("range").agg(F.count("*").alias("n")).collect()
    drawn, before, offsets = sum(r["n"] for r in sizes) * percent // 100, 0, []
    for r in sorted(sizes, key=lambda r: r["range"]):
        offsets.append((r["range"], before))
        before += r["n"]
    offsets = docs.sparkSession.createDataFrame(offsets, "range long, before long")
    ranked = able.join(F.broadcast(offsets), "range").withColumn("rank", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = ["doc_id", "n_words", "n_features", "weight", "score"]
    return ranked.select(*out, "rank").unionAll(scored.where(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank")))
