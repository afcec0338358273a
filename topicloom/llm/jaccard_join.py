"""N-gram Jaccard join by grouped prefixes.

Plan. Each text becomes the set of its distinct word shingles (64-bit hashes). Texts with one and the
same set collapse into a class. Shingles are ordered rarest first by a counting sketch over the whole
corpus, ties by hash; two sets that reach the threshold share a shingle within their prefixes under any
common order, so the sketch's width costs speed alone. Classes with identical prefix and size collapse
into a group. Groups that share a prefix shingle are paired under the size and position filters, pairs
are expanded into members, pruned by a 512-bit parity signature (the Hamming distance of two signatures
never exceeds the symmetric difference of the sets), and verified on the whole sets.

Skew. A prefix shingle of very many classes is first cut down by leaders: each of its classes is
verified against a few of them, linear in the bucket. The pairs that remain are sought only between
classes that are in different components by then, since further links inside a component do not change
it. So a large group of near copies costs about as many verifications as it has members.

Links. Each link joins two classes of one component, so with components known all links are counted
exactly: a component's sets are dealt into blocks, and each pair of blocks is compared by one product
of their incidence matrices, whatever the group's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytes as B
from . import idfilter
from .components import connected_components
from .store import Store

SKETCH_BITS = 20
SKETCH_PARTS = 64
#: A set of more shingles than this has a signature of WIDE bits as well; 512 bits tell large sets apart badly.
LARGE, WIDE = 1024, 8192
#: Classes of a bucket from which its leaders are verified first.
HOT = 32
#: Shingles of a block of sets whose links are counted at once, about, where each set counts as SET more.
BLOCK, SET = 200_000, 400
#: Shingles of one product.
COLUMNS = 4096


def _shingles(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, offsets = B.texts_of(batch.column(1))
    for row, _, block, at in B.blocks(data, offsets):
        start, end, bounds = B.words_of(block, at)
        hashes = B.hashes(B.LOWER[block], start, end)
        yield row, *B.grams(hashes, bounds, words, short=True)


def _sketch(docs: DataFrame, words: int) -> np.ndarray:
    """Occurrences of all shingles by the leading bits of their hash: 2 ** SKETCH_BITS counters."""
    width = (1 << SKETCH_BITS) // SKETCH_PARTS

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, grams, _ in _shingles(batch, words):
                total += np.bincount((grams >> B.U64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
        zip_ = pa.Codec("zstd")
        parts = [(k, total[k * width : (k + 1) * width].astype(np.uint32)) for k in range(SKETCH_PARTS)]
        parts = [(k, zip_.compress(p.tobytes(), asbytes=True)) for k, p in parts if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], ["part", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        zip_ = pa.Codec("zstd")
        for batch in batches:
            for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one = np.frombuffer(zip_.decompress(p, decompressed_size=4 * width, asbytes=True), np.uint32)
                sums[k] = sums.get(k, 0) + one.astype(np.int64)
        rows = [(k, np.minimum(v, 0xFFFFFFFF).astype(np.uint32).tobytes()) for k, v in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    parts = docs.mapInArrow(B.released(count), schema).repartition(SKETCH_PARTS, "part").mapInArrow(B.released(add), schema).collect()
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for part, counts in parts:
        out[part * width : (part + 1) * width] = np.frombuffer(bytes(counts), np.uint32)
    return out


def _parity(own: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the set's members by the last bits of their hashes, as 64-bit integers."""
    return np.packbits(np.bincount((own & B.U64(bits - 1)).astype(np.int64), minlength=bits) & 1 == 1).view(np.int64)


def _prefixes(docs: DataFrame, words: int, num: int, den: int, sketch: np.ndarray) -> DataFrame:
    """A row for each document: its set's size, digest, prefix, the prefix's digest and the signature."""

    def rows(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n", "digest", "prefix", "pkey", "bits", "wide")}
            for _, grams, bounds in _shingles(batch, words):
                for t in range(len(bounds) - 1):
                    own = np.unique(grams[bounds[t] : bounds[t + 1]])
                    n = len(own)
                    order = np.argsort(sketch[(own >> B.U64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                    prefix = own[order[: n - -(-num * n // den) + 1 if n else 0]]
                    out["n"].append(n)
                    out["digest"].append(_digest_of(own))
                    out["prefix"].append(prefix.view(np.int64))
                    out["pkey"].append(hashlib.blake2b(prefix.tobytes() + n.to_bytes(8, "little"), digest_size=16).digest())
                    out["wide"].append(_parity(own, WIDE) if n > LARGE else None)
                    out["bits"].append(_parity(own, 512))
            arrays = [batch.column(0), pa.array(out["n"], pa.int64()), pa.array(out["digest"], pa.binary()), pa.array(out["prefix"], pa.list_(pa.int64())), pa.array(out["pkey"], pa.binary())]
            bits = np.array(out["bits"], np.int64).reshape(-1, 8)
            arrays += [pa.array(bits[:, i]) for i in range(8)]
            arrays.append(pa.array(out["wide"], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *list(out)[:4], *(f"b{i}" for i in range(8)), "wide"])

    kind = docs.schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, n long, digest binary, prefix array<long>, pkey binary, " + ", ".join(f"b{i} long" for i in range(8)) + ", wide array<long>"
    return docs.mapInArrow(B.released(rows), schema)


def _sets(docs: DataFrame, words: int, wanted: bytes) -> DataFrame:
    """(digest, members) of the documents that the filter lets through."""

    def rows(batches):
        mask = idfilter.mask_of(wanted)
        for batch in batches:
            batch = batch.filter(idfilter.passes(batch.column(0), mask))
            digests, sets = [], []
            for _, grams, bounds in _shingles(batch, words):
                for t in range(len(bounds) - 1):
                    own = np.unique(grams[bounds[t] : bounds[t + 1]])
                    digests.append(_digest_of(own))
                    sets.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["digest", "members"])

    return docs.mapInArrow(B.released(rows), "digest binary, members array<long>").dropDuplicates(["digest"])


def _near(a: str, b: str, num: int, den: int) -> Column:
    """What size and signature leave possible."""
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.b{i}").bitwiseXOR(F.col(f"{b}.b{i}"))) for i in range(1, 8)), F.bit_count(F.col(f"{a}.b0").bitwiseXOR(F.col(f"{b}.b0"))))
    return (den * F.least(x, y) >= num * F.greatest(x, y)) & ((den + num) * apart <= (den - num) * (x + y))


def _verified(pairs: DataFrame, classes: DataFrame, large: DataFrame, docs: DataFrame, words: int, num: int, den: int, store: Store) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets reach the threshold. large: cid, n, wide of large sets."""
    x, y = (large.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("wide").alias(f"w{c}")) for c in "ab")
    apart = F.aggregate(F.zip_with("wa", "wb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    may = F.col("wa").isNull() | F.col("wb").isNull() | ((den + num) * apart <= (den - num) * (F.col("na") + F.col("nb")))
    pairs = store.put(pairs.distinct().join(x, "a", "left").join(y, "b", "left").where(may).select("a", "b"), "candidates")
    nodes = store.put(classes.join(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "cid").select("cid", "digest", "doc_id", "n"), "nodes")
    sets = _sets(docs, words, idfilter.bits_of(nodes))
    sets = store.put(sets.join(nodes, "digest").select("cid", "n", "members"), "sets")
    left = sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("members").alias("ma"))
    right = sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("members").alias("mb"))
    common = F.size(F.array_intersect("ma", "mb"))
    return store.put(pairs.join(left, "a").join(right, "b").where((den + num) * common >= num * (F.col("na") + F.col("nb"))).select("a", "b"), "verified")


def _digest_of(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _degrees(named: DataFrame, docs: DataFrame, words: int, num: int, den: int, store: Store, block: int) -> DataFrame:
    """(cid, n_links) of classes with links. named: root, cid, digest, doc_id and n of each class."""
    totals = named.groupBy("root").agg(F.count("*").alias("classes"), F.sum(F.col("n") + SET).alias("weight")).where("classes > 1")
    dealt = named.join(totals.select("root", F.ceil(F.col("weight") / block).cast("int").alias("blocks")), "root")
    dealt = store.put(dealt.select("root", "cid", "digest", "doc_id", "blocks", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("block")), "dealt")
    sets = _sets(docs, words, idfilter.bits_of(dealt)).join(dealt.drop("doc_id"), "digest")
    both = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda q: F.struct(F.least("block", q).alias("i"), F.greatest("block", q).alias("j")))
    sets = sets.withColumn("pair", F.explode(both)).select("root", "pair.i", "pair.j", "block", "cid", "members")

    def count(table: pa.Table) -> pa.Table:
        lists = table.column("members").combine_chunks()
        values, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        own, m = table.column("block").to_numpy(), len(sizes)
        row = np.repeat(np.arange(m), sizes)
        _, col, times = np.unique(values, return_inverse=True, return_counts=True)
        shared = times[col] > 1
        row, col = row[shared], (np.cumsum(times > 1) - 1)[col[shared]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        common = np.zeros((m, m))
        for c in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
            a, b = np.searchsorted(col, (c, c + COLUMNS))
            has = np.zeros((m, COLUMNS), np.float32)
            has[row[a:b], col[a:b] - c] = 1
            common += has @ has.T
        link = (den + num) * common >= num * (sizes[:, None] + sizes[None, :])
        np.fill_diagonal(link, False)
        if table.column("i")[0] != table.column("j")[0]:
            link &= own[:, None] != own[None, :]
        return pa.table({"cid": table.column("cid"), "n_links": pa.array(link.sum(1).astype(np.int64))})

    return sets.groupBy("root", "i", "j").applyInArrow(count, "cid long, n_links long").groupBy("cid").agg(F.sum("n_links").alias("n_links"))


def _components(docs: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int, links_too: bool = False, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, class_size, n_links, digest of the set and root, which tells components apart.

    n_links is null without ``links_too``.
    """
    spark = docs.sparkSession
    store = Store(spark, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = _prefixes(docs, words, num, den, _sketch(docs, words)).withColumn("rid", F.monotonically_increasing_id())
    rows = store.put(rows, "rows")
    bits = [f"b{i}" for i in range(8)]

    # Classes and groups are found on thin rows; prefixes and signatures move once, for one row of each class.
    classes = rows.where("n > 0").groupBy("digest").agg(F.min("rid").alias("cid"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n").cast("int").alias("n"), F.first("pkey").alias("pkey"))
    classes = store.put(classes, "classes")
    leads = classes.groupBy("pkey").agg(F.min("cid").alias("gid"), F.count("*").alias("size"))
    thin = classes.join(leads, "pkey").select("cid", "gid", "size", "n")
    members = store.put(rows.select(F.col("rid").alias("cid"), "pkey", "prefix", *bits, "wide").join(thin, "cid").withColumn("prefix", F.when(F.col("cid") == F.col("gid"), F.col("prefix"))), "members")
    groups = members.where("cid = gid")
    large = members.where("wide is not null").select("cid", "n", "wide")

    # A group of several classes is one bucket more, by the prefix as a whole.
    tokens = groups.select("gid", "n", "size", F.posexplode("prefix").alias("pos", "token"))
    whole = groups.where("size > 1").select("gid", "n", "size", F.lit(0).alias("pos"), F.xxhash64("pkey").alias("token"))
    tokens = tokens.unionByName(whole)
    counts = tokens.groupBy("token").agg(F.sum("size").alias("c")).where("c > 1")
    buckets = store.put(tokens.select("token", "gid", "n", "pos").join(counts, "token").select("token", "gid", "n", "pos", (F.col("c") > HOT).alias("hot")), "buckets")
    members = members.select("gid", "cid", "n", *bits)

    found = None
    hot = buckets.where("hot")
    comp = None
    if not hot.isEmpty():
        hot = store.put(hot.select("token", "gid", "pos").join(members, "gid").select("token", "cid", "n", "pos", *bits), "hot")
        one = F.struct(*("cid", "n", *bits))
        leaders = hot.groupBy("token").agg(*(F.min(F.struct(F.xxhash64("cid", F.lit(k)).alias("h"), one.alias("x"))).alias(f"k{k}") for k in range(4)))
        leaders = leaders.select("token", F.explode(F.array_distinct(F.array(*(f"k{k}.x" for k in range(4))))).alias("x")).select("token", F.col("x.cid").alias("leader"), F.struct("x.n", *(f"x.{b}" for b in bits)).alias("l"))
        pairs = leaders.join(hot.withColumn("m", F.struct("n", *bits)), "token").where("leader <> cid").where(_near("l", "m", num, den))
        found = _verified(pairs.select(F.least("leader", "cid").alias("a"), F.greatest("leader", "cid").alias("b")), classes, large, docs, words, num, den, store)
        comp = connected_components(found, store)

    def with_comp(df: DataFrame) -> DataFrame:
        if comp is None:
            return df.withColumn("comp", F.col("cid"))
        return df.join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("root", "cid")).drop("root")

    members = store.put(with_comp(members), "members")
    # comp of a group: its members' where they agree, else a value that equals no other.
    gcomp = members.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).select("gid", "size", F.expr("if(lo = hi, lo, -1 - gid)").alias("comp"), (F.col("lo") != F.col("hi")).alias("mixed"))
    x, y = F.col("x.n"), F.col("y.n")
    possible = (den * F.least(x, y) >= num * F.greatest(x, y)) & ((den + num) * (1 + F.least(x - F.col("x.pos"), y - F.col("y.pos")) - 1) >= num * (x + y))
    cold = buckets.where("not hot").join(gcomp.select("gid", "comp"), "gid")
    met = cold.alias("x").join(cold.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.gid") < F.col("y.gid")) & (F.col("x.comp") != F.col("y.comp")) & possible)
    met = met.select(F.col("x.gid").alias("g"), F.col("y.gid").alias("h")).distinct()
    # A larger group is a hot bucket by its prefix as a whole, and is looked at there.
    met = met.unionAll(gcomp.where(F.col("mixed") & (F.col("size") <= HOT)).select(F.col("gid").alias("g"), F.col("gid").alias("h")))
    mx, my = members.alias("x"), members.alias("y")
    apart = F.col("x.comp") != F.col("y.comp")
    pairs = met.join(mx, F.col("g") == F.col("x.gid")).join(my, (F.col("h") == F.col("y.gid")) & apart & ((F.col("g") < F.col("h")) | (F.col("x.cid") < F.col("y.cid"))) & _near("x", "y", num, den))
    pairs = pairs.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b"))
    if found is not None:
        # Within a bucket, pairs inside its largest component need no look: one side is always outside it.
        own = store.put(with_comp(hot), "hot")
        largest = own.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("largest"))
        outside = own.join(largest, "token").where("comp <> largest").drop("largest")
        more = outside.alias("x").join(own.alias("y"), (F.col("x.token") == F.col("y.token")) & apart & possible & _near("x", "y", num, den))
        pairs = pairs.unionAll(more.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")))
    links = _verified(pairs, classes, large, docs, words, num, den, store)
    links = links if found is None else links.unionAll(found)

    roots = connected_components(links, store)
    named = classes.select("cid", "digest", "doc_id", "copies", "n").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = store.put(named.join(least, "root").select("cid", "digest", "doc_id", "n", "root", "component_id", F.col("copies").alias("class_size")), "named")
    none = F.lit(0 if links_too else None).cast("long")
    if links_too:
        named = named.join(_degrees(named, docs, words, num, den, store, block), "cid", "left").withColumn("n_links", F.coalesce("n_links", none))
    else:
        named = named.withColumn("n_links", none)
    named = named.select("digest", "root", "component_id", "class_size", "n_links")
    full = rows.where("n > 0").select("doc_id", F.col("n").alias("n_shingles"), "digest").join(named, "digest").select("doc_id", "n_shingles", "component_id", "class_size", "n_links", "digest", "root")
    bare = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("class_size"), none.alias("n_links"), "digest", F.lit(None).cast("long").alias("root"))
    return full.unionAll(bare)


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, class_size, n_links.

    Words are lower-cased (A to Z) runs of bytes other than space and U+0009 to U+000D; a set holds the
    distinct runs of ``words`` words, or all words as one run where there are fewer. Rows link when the
    sets' Jaccard similarity is at least num / den; component_id is the smallest id that links reach.
    Rows of equal sets are a class; n_links is how many other classes the row's class links to, so that half the sum over
    classes is the number of links between different sets. block sets where work is split; it does not change results.
    ids are integers. A row with a null or empty text, or white space alone, has n_shingles 0 and is its
    own component. Rows that repeat an id are linked by their own texts; a null id counts as larger than
    any other. An empty table gives an empty one. Columns other than the two named are not read.
    """
    found = _components(docs, id_col, text_col, words, num, den, links_too=True, block=block)
    return found.select("doc_id", "n_shingles", "component_id", "class_size", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component: that with the least id (nulls last), then any of its equals.

    Rows and columns, whatever their names, are otherwise unchanged; rows with a null or empty text or without words all stay,
    and an empty table gives an empty one. Only the texts of rows in components
    of several rows, and of some others by chance, are exchanged. See near_duplicate_components for the links.
    """
    store = Store(docs.sparkSession, "keep-one")
    found = store.put(_components(docs, id_col, text_col, words, num, den).where("n_shingles > 0"), "components")
    sets = found.groupBy("doc_id", "digest", "root").agg(F.count("*").alias("n"))
    several = sets.groupBy("root").agg(F.sum("n").alias("rows"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("one"))
    several = store.put(several.select("root", "rows", "one.doc_id", "one.digest"), "kept")
    bits = idfilter.bits_of(sets.join(several.where("rows > 1").select("root"), "root"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    at, none = docs.columns.index(text_col), _digest_of(np.zeros(0, B.U64))

    def parted(stay: bool):
        """Rows that stay without more ado, those that the filter stops or that have no words; or the others with their digests."""

        def pick(batches):
            mask = idfilter.mask_of(bits)
            for batch in B.slices(batches):
                through = idfilter.passes(batch.column(0), mask)
                if stay:
                    yield batch.filter(pc.invert(through)).select(["row"])
                some = batch.filter(through)
                thin = pa.RecordBatch.from_arrays([some.column(0), some.column(1).field(at)], ["id", "text"])
                digests = [_digest_of(np.unique(grams[bounds[t] : bounds[t + 1]])) for _, grams, bounds in _shingles(thin, words) for t in range(len(bounds) - 1)]
                bare = pa.array([d == none for d in digests], pa.bool_())
                if stay:
                    yield some.filter(bare).select(["row"])
                else:
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(digests, pa.binary())], ["id", "row", "digest"]).filter(pc.invert(bare))

        return B.released(pick)

    kind = rows.schema["row"].dataType.simpleString()
    stays = rows.mapInArrow(parted(True), f"row {kind}")
    some = rows.mapInArrow(parted(False), f"id long, row {kind}, digest binary")
    kept = several.select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept"))
    one = some.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept"))).dropDuplicates(["kept_id", "kept"])
    return stays.select("row.*").unionByName(one.select("row.*"))
