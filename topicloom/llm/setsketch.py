"""Near duplicates by SetSketch registers.

Plan. Each text becomes the set of its distinct word shingles (64-bit hashes); equal sets collapse into a class. A class that
can link at all gets a sketch of REGISTERS registers: each shingle has an exponential minimum for each register, made of its hash alone, and
a register keeps the least of them, truncated to powers of BASE. So registers of two sets merge by maxima, and agree with the probability
of their Jaccard similarity or a little more. BANDS bands of ROWS registers are hashed; classes that agree in a band meet there.
Classes that meet are compared by all their registers: the likelihood of the counts of greater, less and equal ones, the sizes being known, has one greatest
value over the similarity. A pair is dropped if its best similarity is below the threshold and explains the registers better by a factor of exp(SURE);
the others are verified on the whole sets, so every link is exact.

What can be lost. Two sets at a similarity of 0.8 meet in no band with probability (1 - 0.8 ** 5) ** 51 = 1.6e-9, and are dropped by the likelihood in
about exp(-SURE) = 2e-9 of cases; there is no cap on bands, buckets or partners.

Making registers. A shingle's minima are the first arrivals of a Poisson process whose arrivals fall on registers at random,
so they come in ascending order and a set stops once no arrival can be less than any of its minima: some REGISTERS * ln(REGISTERS) arrivals
a set rather than REGISTERS for each shingle.

Skew. A bucket of many classes is first cut down by leaders: each class is verified against a few of the most central classes that it meets, some LEADERS * ROUNDS in
all. What remains are pairs of classes that are in different components by then and whose registers' last bits are alike.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytes as B
from . import idfilter
from .components import connected_components
from .jaccard_join import _digest_of, _near, _parity, _sets, _shingles
from .store import Store

#: Registers of a sketch, of which BANDS * ROWS are in bands.
REGISTERS, BANDS, ROWS = 256, 51, 5
#: Registers hold floor(1 - log(minimum) / log(BASE)), minima having RATE arrivals for each shingle and unit of time, from 0 to TOP.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: Log-likelihood by which another similarity must be better for a pair to be dropped.
SURE = 20.0
#: Classes of a bucket from which leaders are verified first, leaders that a class is compared with in a round, and rounds.
HOT, LEADERS, ROUNDS = 32, 4, 2
#: Columns that hold the last bits of the registers, and the parities of a set's members by the last bits of their hashes.
LAST, PARITIES = ["q0", "q1", "q2", "q3"], [f"b{i}" for i in range(8)]
#: Arrivals that are drawn at once.
DRAWN = 1 << 18


def _arrivals(shingles: np.ndarray, first: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """(waiting time, register) of the next ``many`` arrivals of each shingle, the first of them its ``first``-th."""
    n = first[:, None] + np.arange(many)
    bits = B.mix(shingles[:, None] + (n + 1).astype(B.U64) * B.U64(0x9E3779B97F4A7C15))
    unit = ((bits >> B.U64(24)).astype(np.float64) + 0.5) / (1 << 40)
    return -np.log(unit) / (RATE * REGISTERS), ((bits & B.U64((1 << 24) - 1)) * B.U64(REGISTERS) >> B.U64(24)).astype(np.int64)


def registers_of(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The registers, a row of uint16 for each set of distinct shingles; a set lies between two neighbours of ``bounds`` and is not empty."""
    sets = len(bounds) - 1
    least = np.full((sets, REGISTERS), np.inf)
    flat = least.reshape(-1)
    own = np.repeat(np.arange(sets), np.diff(bounds))
    time, done = np.zeros(len(shingles)), np.zeros(len(shingles), np.int64)
    alive, want = np.arange(len(shingles)), 6 * REGISTERS
    while len(alive):
        # As many arrivals a shingle as give its set about those wanted, in powers of two.
        many = np.ceil(np.log2(np.maximum(want / np.bincount(own[alive], minlength=sets)[own[alive]], 1))).astype(np.int64)
        for power in np.unique(many):
            k = 1 << int(power)
            group = alive[many == power]
            for start in range(0, len(group), max(1, DRAWN // k)):
                some = group[start : start + max(1, DRAWN // k)]
                waits, register = _arrivals(shingles[some], done[some], k)
                waits[:, 0] += time[some]
                at = np.add.accumulate(waits, axis=1)
                np.minimum.at(flat, (own[some][:, None] * REGISTERS + register).reshape(-1), at.reshape(-1))
                time[some], done[some] = at[:, -1], done[some] + k
        alive = alive[time[alive] < least.max(1)[own[alive]]]
        want = 2 * REGISTERS
    return np.clip(np.floor(1 - np.log(least) / math.log(BASE)), 0, TOP).astype(np.uint16)


def bands_of(registers: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band of each row."""
    parts = registers[:, : BANDS * ROWS].reshape(len(registers), BANDS, ROWS).astype(B.U64)
    out = np.broadcast_to(B.mix(np.arange(1, BANDS + 1, dtype=B.U64)), parts.shape[:2])
    for i in range(ROWS):
        out = B.mix(out ^ (parts[:, :, i] + B.U64(1)) * B.U64(0x9E3779B97F4A7C15))
    return out.view(np.int64)


def estimate(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, against: float) -> tuple[np.ndarray, np.ndarray]:
    """(likeliest similarity, its log-likelihood over that of ``against``) of pairs of rows of registers, given the sets' sizes."""
    more, less = (x > y).sum(1), (x < y).sum(1)
    same = REGISTERS - more - less
    u, v = n_x / (n_x + n_y), n_y / (n_x + n_y)
    most = np.minimum(u / v, v / u)

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        p, q = (-np.log1p(-np.clip(z, 0, 1) * (BASE - 1) / BASE) / math.log(BASE) for z in (u - v * j, v - u * j))
        tiny = 1e-300
        return more * np.log(np.maximum(p, tiny)) + less * np.log(np.maximum(q, tiny)) + same * np.log(np.maximum(1 - p - q, tiny))

    low, high = np.zeros(len(most)), most.copy()
    golden = (math.sqrt(5) - 1) / 2
    for _ in range(40):  # the likelihood has one maximum
        a, b = high - golden * (high - low), low + golden * (high - low)
        left = log_likelihood(a) > log_likelihood(b)
        low, high = np.where(left, low, a), np.where(left, b, high)
    best = (low + high) / 2
    return best, log_likelihood(best) - log_likelihood(np.minimum(against, most))


def _sketches(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, digest, registers, their last bits, parities) of each row; registers are null for a set that can be like no other."""

    def rows(batches):
        for batch in B.slices(batches, 1024):
            sizes, digests, registers, parities = [np.zeros(0, np.int64)], [], [np.zeros((0, REGISTERS), np.uint16)], [np.zeros((0, 8), np.int64)]
            for _, grams, bounds in _shingles(batch, words):
                sets = [np.unique(grams[bounds[t] : bounds[t + 1]]) for t in range(len(bounds) - 1)]
                n = np.array([len(s) for s in sets], np.int64)
                # The most alike of all other sets has one shingle more.
                able = den * n >= num * (n + 1)
                made = np.zeros((len(sets), REGISTERS), np.uint16)
                if able.any():
                    made[able] = registers_of(np.concatenate([s for s, ok in zip(sets, able, strict=True) if ok]), np.concatenate([[0], np.cumsum(n[able])]))
                sizes.append(n)
                digests += [_digest_of(s) for s in sets]
                registers.append(made)
                parities.append(np.array([_parity(s, 512) for s in sets], np.int64).reshape(-1, 8))
            n, matrix = np.concatenate(sizes), np.concatenate(registers)
            able = den * n >= num * (n + 1)
            packed = pa.array([r.tobytes() if ok else None for r, ok in zip(matrix, able, strict=True)], pa.binary())
            bits = np.concatenate([np.packbits((matrix & 1).astype(np.uint8), axis=1).view(np.int64), np.concatenate(parities)], axis=1)
            columns = [batch.column(0), pa.array(n), pa.array(digests, pa.binary()), packed, *(pa.array(bits[:, i]) for i in range(bits.shape[1]))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "digest", "registers", *LAST, *PARITIES])

    longs = ", ".join(f"{c} long" for c in LAST + PARITIES)
    return docs.mapInArrow(B.released(rows), f"doc_id long, n long, digest binary, registers binary, {longs}")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def _banded(classes: DataFrame) -> DataFrame:
    """(token, cid, n): a row for each band of each class."""

    def rows(batches):
        for batch in B.slices(batches):
            tokens = bands_of(_matrix(batch.column(2))).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(tokens), *(pa.array(np.repeat(batch.column(i).to_numpy(), BANDS)) for i in (0, 1))], ["token", "cid", "n"])

    return classes.select("cid", "n", "registers").mapInArrow(B.released(rows), "token long, cid long, n int")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, num: int, den: int, store: Store) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets reach the threshold; first the registers are asked."""
    def likely(batches):
        for batch in B.slices(batches, 4096):
            n_a, n_b = (batch.column(i).to_numpy().astype(np.float64) for i in (2, 3))
            best, gain = estimate(_matrix(batch.column(4)), _matrix(batch.column(5)), n_a, n_b, num / den)
            yield batch.filter(pa.array((best >= num / den) | (gain <= SURE))).select(["a", "b"])

    thin = classes.select("cid", "n", "registers", *LAST, *PARITIES)
    met = pairs.distinct().join(thin.alias("x"), F.col("a") == F.col("x.cid")).join(thin.alias("y"), (F.col("b") == F.col("y.cid")) & _alike(num, den))
    met = met.select("a", "b", F.col("x.n").alias("na"), F.col("y.n").alias("nb"), F.col("x.registers").alias("ra"), F.col("y.registers").alias("rb"))
    pairs = store.put(met.mapInArrow(B.released(likely), "a long, b long"), "likely")
    nodes = store.put(classes.join(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "cid").select("cid", "digest", "doc_id", "n"), "nodes")
    sets = _sets(docs, words, idfilter.bits_of(nodes))
    sets = store.put(sets.join(nodes, "digest").select("cid", "n", "members"), "sets")
    left, right = (sets.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("members").alias(f"m{c}")) for c in "ab")
    common = F.size(F.array_intersect("ma", "mb"))
    return store.put(pairs.join(left, "a").join(right, "b").where((den + num) * common >= num * (F.col("na") + F.col("nb"))).select("a", "b"), "verified")


def _meet(num: int, den: int) -> Column:
    """Rows x and y of one bucket that are in different components and near enough in size."""
    sizes = den * F.least("x.n", "y.n") >= num * F.greatest("x.n", "y.n")
    return (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")) & sizes


def _alike(num: int, den: int) -> Column:
    """What the members' parities leave possible, which is exact and tells small sets apart, and the registers' last bits, which do for large ones.

    Registers that differ have unlike last bits half of the time, and eight deviations more are let through.
    """
    unlike = (1 - num / den) / 2
    most = REGISTERS * unlike + 8 * math.sqrt(REGISTERS * unlike * (1 - unlike))
    apart = sum((F.bit_count(F.col(f"x.{q}").bitwiseXOR(F.col(f"y.{q}"))) for q in LAST[1:]), F.bit_count(F.col("x.q0").bitwiseXOR(F.col("y.q0"))))
    return _near("x", "y", num, den) & (apart <= most)


def _with_component(df: DataFrame, comp: DataFrame | None) -> DataFrame:
    if comp is None:
        return df.withColumn("comp", F.col("cid"))
    return df.join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("root", "cid")).drop("root")


def _with_largest(own: DataFrame) -> DataFrame:
    """The component that most classes of a bucket are in."""
    sizes = own.groupBy("token", "comp").agg(F.count("*").alias("c"))
    return own.join(sizes.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("largest")), "token")


def _led(own: DataFrame, first: bool, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of a class and the LEADERS most central leaders that it meets.

    A bucket has two: the most central class of its largest component and that of the others; at first, when all are alone, any
    class is the second. Once there are components only classes outside the largest are led.
    """
    one, inside = F.struct("far", "cid", "n", "comp", *LAST, *PARITIES), F.col("comp") == F.col("largest")
    some = F.struct(F.xxhash64("cid").alias("far"), "cid", "n", "comp", *LAST, *PARITIES)
    leads = [F.min(one), F.min(some)] if first else [F.min(F.when(inside, one)), F.min(F.when(~inside, one))]
    leaders = own.groupBy("token").agg(*(x.alias(f"k{i}") for i, x in enumerate(leads)))
    leaders = leaders.select("token", F.explode(F.array("k0", "k1")).alias("x")).where("x is not null").select("token", "x.*")
    led = own if first else own.where(~inside)
    met = leaders.alias("x").join(led.alias("y"), _meet(num, den) & _alike(num, den)).select("y.cid", F.struct("x.far", F.col("x.cid").alias("leader")).alias("x"))
    # A class has two leaders a band at most.
    few = met.groupBy("cid").agg(F.slice(F.array_sort(F.collect_set("x")), 1, LEADERS).alias("x")).select("cid", F.explode("x.leader").alias("leader"))
    return few.select(F.least("leader", "cid").alias("a"), F.greatest("leader", "cid").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100, hot: int = HOT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, class_size, kept.

    Words are lower-cased (A to Z) runs of bytes other than space and U+0009 to U+000D; a set holds the distinct runs of ``words`` words, or
    all words as one run where there are fewer. Rows link when their sets' Jaccard similarity is at least num / den, at 0.8 or more for the bands to find all (see
    above); component_id is the smallest id that links reach, class_size the number of rows with the very same set, kept tells whether doc_id is the component's.
    ``hot`` sets where work is split; it does not change results.

    A row with a null or empty text, or white space alone, has n_shingles 0 and is its own component. Rows that repeat an id are linked by their own texts, and are
    kept or not together; a null id counts as larger than any other and is kept if the whole component has no other. An empty table gives an
    empty one. ids are integers; other columns are not read.
    """
    spark = docs.sparkSession
    store = Store(spark, "setsketch")
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = store.put(_sketches(docs, words, num, den).withColumn("rid", F.monotonically_increasing_id()), "rows")
    classes = rows.where("n > 0").groupBy("digest").agg(F.min("rid").alias("cid"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max("n").cast("int").alias("n"))
    classes = store.put(classes, "classes")
    sketched = rows.where("registers is not null").select(F.col("rid").alias("cid"), "registers", *LAST, *PARITIES)
    sketched = store.put(sketched.join(classes.select("cid", "digest", "doc_id", "n"), "cid"), "sketched")

    tokens = store.put(_banded(sketched), "tokens")
    counts = tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    buckets = store.put(tokens.join(counts, "token").select("token", "cid", "n", "c"), "buckets")
    busy = buckets.where(F.col("c") > hot)
    links = comp = None
    if not busy.isEmpty():
        # The more company a class has in all its buckets, the nearer it is to the middle of a group.
        middle = busy.groupBy("cid").agg((-F.sum("c")).alias("far"))
        busy = store.put(busy.drop("c").join(middle, "cid").join(sketched.select("cid", *LAST, *PARITIES), "cid"), "busy")
        for k in range(ROUNDS):
            own = store.put(_with_largest(_with_component(busy, comp)), "round")
            more = _verified(_led(own, k == 0, num, den), sketched, docs, words, num, den, store)
            links = more if links is None else links.unionAll(more)
            comp = connected_components(links, store)

    cold = _with_component(buckets.where(F.col("c") <= hot), comp)
    pairs = cold.alias("x").join(cold.alias("y"), _meet(num, den) & (F.col("x.cid") < F.col("y.cid"))).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))
    if comp is not None:
        # Pairs inside a bucket's largest component need no look: one side of each other pair is outside it.
        own = store.put(_with_largest(_with_component(busy, comp)), "busy")
        more = own.where("comp <> largest").alias("x").join(own.alias("y"), _meet(num, den) & _alike(num, den))
        pairs = pairs.unionAll(more.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")))
    more = _verified(pairs, sketched, docs, words, num, den, store)
    links = more if links is None else links.unionAll(more)

    roots = connected_components(links, store)
    named = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "root").select("digest", "component_id", F.col("copies").alias("class_size"))
    full = rows.where("n > 0").select("doc_id", F.col("n").alias("n_shingles"), "digest").join(named, "digest").select("doc_id", "n_shingles", "component_id", "class_size")
    bare = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("class_size"))
    return full.unionAll(bare).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
