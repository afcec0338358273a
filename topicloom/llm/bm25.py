"""Exact BM25 top-k search with block-max WAND in shards.

Document frequencies, lengths and the number of documents are counted over the whole corpus, so a
shard's scores are final and merging the shards' best k by query is exact. Texts are read once, in the tasks that hold them: each makes
the inverted index of some megabytes of text, a *shard*, with postings by term and document, and the indexes
are written. Queries come in blocks of bounded size, each of which goes to every shard's task.

A shard's documents are put into an order in which like ones are neighbours (by their most frequent term, then
length), and all terms' postings are cut at the same documents (document-aligned blocks, Dimopoulos, Nepomnyachiy and Suel
2013); of each term and block the greatest impact is kept. A batch of like queries walks through the blocks together, each query
with its own cursor and threshold, the k-th best score so far. WAND's pivot is the next block in which the
bounds of a query's terms reach its threshold; what lies before it is skipped. Where a query stops, a second pivot takes the
documents that reach the threshold by a bound of their own, a product in single precision with its error added, and at the
end those left are scored exactly. Steps with the best bounds come first, so that thresholds are high early.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytes as B
from .store import Store

K1, LENGTH_SHARE = 1.2, 0.75
#: Bytes of text of a shard, about; bytes of a block of queries as it is sent, at most, if one query alone is not larger.
SHARD_BYTES = 10 << 20
QUERY_BYTES = 24 << 20
#: Documents of a block, and of a step of the walk; cells of a shard's table of frequent terms, and their most.
BLOCK, STEP = 16, 512
CELLS, FREQUENT = 3_000_000, 1024
#: Queries that walk together, and cells of their scores.
BATCH, SCORES = 256, 800_000
#: Terms by which a shard's documents are ordered.
LIKE = 64
#: Relative error of a sum of FREQUENT products in single precision, at most.
ERROR = FREQUENT * 2.0**-23
#: Stands for a null id inside a shard.
NO_ID = -(1 << 63)
#: Queries whose best documents are merged in one task, and shards whose are merged at once.
PART, MERGED = 128, 64
_INDEX = "shard long, ids array<long>, lengths array<int>, term array<long>, check array<long>, df array<int>, docs binary, tfs binary"


def _terms(column: pa.Array):
    """For runs of rows: (first row, term hashes in two lanes, bounds by row)."""
    data, offsets = B.texts_of(column)
    for row, _, block, at in B.blocks(data, offsets):
        block = B.LOWER[block]
        start, end, bounds = B.words_of(block, at)
        yield row, (B.hashes(block, start, end), B.hashes(block, start, end, 1)), bounds


def _distinct(keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(order, firsts of equal runs in it) of the rows of keys, the first key counting most."""
    order = np.argsort(keys[0], kind="stable")
    same = keys[0][order][1:] == keys[0][order][:-1]
    # Rows are in order by the later keys already, or the first key alone leaves ties to settle.
    if any((k[order][1:] < k[order][:-1])[same].any() for k in keys[1:]):
        order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def _index(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """A row for each shard. docs and tfs go along the terms; df is the number of a term's postings."""

    def shard(number: int, ids: list, texts: list[pa.Array]) -> pa.RecordBatch:
        column = pa.concat_arrays(texts)
        h, g, d = [], [], []
        for row, (one, two), bounds in _terms(column):
            h.append(one)
            g.append(two)
            d.append((row + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))).astype(np.int64))
        h, g, d = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((h, B.U64), (g, B.U64), (d, np.int64)))
        lengths = np.bincount(d, minlength=len(column))
        order, cells = _distinct((h, g, d))
        tf = np.diff(np.r_[cells, len(h)])
        h, g, d = h[order[cells]], g[order[cells]], d[order[cells]]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])][: len(h)])
        df = np.diff(np.r_[first, len(h)])
        # Like documents become neighbours.
        top = np.full(len(column), -1)
        for i, t in enumerate(np.argsort(df, kind="stable")[-LIKE:]):
            top[d[first[t] : first[t] + df[t]]] = i
        like = np.lexsort((lengths, top))
        place = np.empty(len(column), np.int64)
        place[like] = np.arange(len(column))
        d = place[d]
        again = np.argsort(np.repeat(np.arange(len(df)) * len(column), df) + d, kind="stable")
        d, tf, lengths = d[again], tf[again], lengths[like]
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        cols = [pa.concat_arrays(ids).take(pa.array(like)), pa.array(lengths.astype(np.int32)), pa.array(h[first].view(np.int64)), pa.array(g[first].view(np.int64)), pa.array(df.astype(np.int32))]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *map(one, cols), pa.array([d.astype(np.int32).tobytes()], pa.binary()), pa.array([tf.astype(np.int32).tobytes()], pa.binary())], ["shard", "ids", "lengths", "term", "check", "df", "docs", "tfs"])

    def rows(batches):
        ids, texts, held = [], [], 0
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                ids.append(part.column(0))
                # Copied, so that a batch does not stay for a slice of it.
                texts.append(pa.concat_arrays([part.column(1).fill_null(""), pa.array([], part.column(1).type)]))
                held += texts[-1].nbytes
                if held >= shard_bytes:
                    yield shard(number, ids, texts)
                    ids, texts, held, number = [], [], 0, number + 1
        if texts:
            yield shard(number, ids, texts)

    return docs.mapInArrow(B.released(rows), _INDEX)


def _query_terms(queries: DataFrame) -> DataFrame:
    """(id, term, check) of the distinct terms of each query."""

    def rows(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, (h, g), bounds in _terms(batch.column(1)):
                own = ids[row + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))]
                order, first = _distinct((own, h, g))
                at = order[first]
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(h[at].view(np.int64)), pa.array(g[at].view(np.int64))], ["id", "term", "check"])

    return queries.mapInArrow(B.released(rows), "id long, term long, check long")


class Shard:
    """The index of one shard, ready for queries."""

    def __init__(self, ids, lengths, term, check, df, docs, tfs, mean_words: float):
        self.ids, self.term, self.check = ids, term.view(B.U64), check.view(B.U64)
        n = self.n = len(ids)
        self.doc = docs
        norm = K1 * (1 - LENGTH_SHARE + LENGTH_SHARE * lengths / (mean_words or 1.0))
        self.impact = tfs * (K1 + 1) / (tfs + norm[docs])
        self.start = np.r_[0, np.cumsum(df)].astype(np.int64)
        often = np.argsort(-df, kind="stable")[: min(FREQUENT, CELLS // max(n, 1))]
        self.table = np.full(len(df), -1)
        self.table[often] = np.arange(len(often))
        # The most frequent terms' impacts as a table, and their greatest in each block.
        self.n_blocks = -(-n // BLOCK)
        self.full = np.zeros((len(often), self.n_blocks * BLOCK))
        for i, t in enumerate(often):
            at = slice(self.start[t], self.start[t + 1])
            self.full[i, docs[at]] = self.impact[at]
        self.half = self.full.astype(np.float32)
        self.most = self.half.reshape(len(often), self.n_blocks, BLOCK).max(2)

    @staticmethod
    def _runs(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        sizes = last - first
        return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())

    def places(self, term: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Where the terms are, -1 for those that the shard lacks."""
        at = np.searchsorted(self.term, term)
        out = np.full(len(term), -1)
        live = np.arange(len(term))
        while len(live):  # more than one step only if terms agree in the first lane
            live = live[at[live] < len(self.term)]
            live = live[self.term[at[live]] == term[live]]
            same = self.check[at[live]] == check[live]
            out[live[same]] = at[live[same]]
            live = live[~same]
            at[live] += 1
        return out

    def search(self, block: dict[str, np.ndarray], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, scores) of all that may be among the best k of each query of a block."""
        place, ends = self.places(block["term"], block["check"]), block["ends"]
        codes = [c[place[c] >= 0] for c in (block["codes"][a:b] for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True))]
        found = [(place[c], block["w"][c]) for c in codes]
        # Queries with the same most frequent terms walk together.
        like = [tuple(np.sort(t[t >= 0])[:3]) for t in (self.table[p] for p, _ in found)]
        order = sorted(range(len(found)), key=lambda i: like[i])
        out: list = [None] * len(found)
        size = max(1, min(BATCH, SCORES // max(1, self.n_blocks * BLOCK)))
        for a in range(0, len(order), size):
            own = order[a : a + size]
            for i, best in zip(own, self._walk([found[i] for i in own], k), strict=True):
                out[i] = best
        return out

    def _walk(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        q, wide = len(queries), self.n_blocks * BLOCK
        light, heavy = np.zeros((q, wide)), np.zeros((q, len(self.full)), np.float32)
        often = []
        for i, (at, w) in enumerate(queries):
            t = self.table[at]
            often.append((t[t >= 0], w[t >= 0]))
            heavy[i, t[t >= 0]] = w[t >= 0]
            rare = at[t < 0]
            posting = self._runs(self.start[rare], self.start[rare + 1])
            light[i] = np.bincount(self.doc[posting], self.impact[posting] * np.repeat(w[t < 0], self.start[rare + 1] - self.start[rare]), wide)
        scored = light.astype(np.float32)
        # What a block can hold at most for each query.
        bound = (heavy @ self.most + scored.reshape(q, self.n_blocks, BLOCK).max(2)) * (1 + 2 * ERROR)
        steps = np.arange(0, self.n_blocks, STEP // BLOCK)
        reach = np.maximum.reduceat(bound, steps, axis=1)
        best, least = np.zeros((q, k), np.float32), np.zeros(q, np.float32)
        hits = []
        for s in np.argsort(-reach.max(0), kind="stable"):
            # Queries whose pivot lies in this step; the others' cursors pass it by.
            live = np.flatnonzero((reach[:, s] >= least) & (reach[:, s] > 0))
            if not len(live):
                continue
            docs = slice(steps[s] * BLOCK, min(steps[s] * BLOCK + STEP, wide))
            score = heavy[live] @ self.half[:, docs] + scored[live, docs]
            best[live] = np.partition(np.concatenate([best[live], score], axis=1), score.shape[1], axis=1)[:, -k:]
            # The k-th best in truth is not below this.
            least[live] = best[live].min(1) * (1 - 2 * ERROR)
            x, y = np.nonzero((score * (1 + 2 * ERROR) >= least[live][:, None]) & (score > 0))
            hits.append((live[x], y + docs.start, score[x, y]))
        if not hits:
            return [(np.zeros(0, np.int64), np.zeros(0))] * q
        own, doc, score = (np.concatenate(x) for x in zip(*hits, strict=True))
        keep = score * (1 + 2 * ERROR) >= least[own]
        own, doc = own[keep], doc[keep]
        order = np.argsort(own, kind="stable")
        own, doc = own[order], doc[order]
        ends = np.searchsorted(own, np.arange(q + 1))
        out = []
        for i, (t, w) in enumerate(often):
            d = doc[ends[i] : ends[i + 1]]
            out.append((d, light[i, d] + w @ self.full[t[:, None], d[None, :]]))
        return out


_BLOCK = {"ids": np.int64, "ends": np.int64, "codes": np.int32, "term": np.uint64, "check": np.uint64, "w": np.float64}


def _packed(asked: DataFrame, blocks: int) -> DataFrame:
    """A row for each block of queries: ids, ends of their codes, codes of their terms, and the block's distinct terms. asked: id, term, check, w."""

    def pack(table: pa.Table) -> pa.Table:
        ids, term, check, w = (table.column(c).to_numpy() for c in ("id", "term", "check", "w"))
        order, first = _distinct((term.view(B.U64), check.view(B.U64)))
        new = np.zeros(len(order), bool)
        new[first] = True
        code = np.empty(len(order), np.int32)
        code[order] = np.cumsum(new, dtype=np.int32) - 1
        own = order[first]
        by = np.lexsort((code, ids))
        ids = ids[by]
        at = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        cols = {"ids": ids[at], "ends": np.r_[at[1:], len(ids)], "codes": code[by], "term": term[own], "check": check[own], "w": w[own]}
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32())} | {c: pa.array([v.tobytes()], pa.binary()) for c, v in cols.items()})

    dealt = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(pack, "block int, " + ", ".join(f"{c} binary" for c in _BLOCK))


def _best(query: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the best k of each query in order, their ranks from 1); ties by the lesser document."""
    order = np.lexsort((doc, -score, query))
    q = query[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]][: len(q)])
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) + 1
    return order[rank <= k], rank[rank <= k]


def _unpacked(table: pa.Table) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("queries", np.int64), ("docs", np.int64), ("scores", np.float64)))


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, doc_id, score) of the best ``k`` rows of ``docs`` for each row of ``queries``.

    Terms are words (runs of bytes other than space and U+0009 to U+000D), A to Z lower-cased; a query has each
    of its terms once. Scores are rounded to 9 digits, ties go to the lesser id. Only rows with a common term
    are found, so queries without words have none. Null texts count as empty, and count among the documents.
    Ids are integers; rows that repeat an id, or have none, are documents of their own, queries that repeat one are one query of all their terms; null query
    ids are left out. Empty tables give an empty one. No other column is read. shard_bytes and query_bytes set where
    work is split; they do not change results. Each block of queries is a job of its own, written before the next.
    """
    spark = docs.sparkSession
    store = Store(spark, "bm25")
    docs, queries = (x.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")) for x in (docs, queries))
    # A shard is a row of many MB: with files of their own, no task holds more than one in Parquet's buffers.
    index = store.put(_index(docs, shard_bytes), "index", file_rows=1)
    whole = index.agg(F.count("*").alias("shards"), F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("words")).first()
    n, mean = whole["n"] or 0, (whole["words"] or 0) / max(1, whole["n"] or 0)
    counts = index.select(F.explode(F.arrays_zip("term", "check", "df")).alias("x")).groupBy("x.term", "x.check").agg(F.sum("x.df").alias("df"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = _query_terms(queries.where("id is not null")).distinct()
    asked = store.put(asked.join(counts, ["term", "check"]).select("id", "term", "check", idf.alias("w")), "asked")
    blocks = max(1, -(-asked.count() * 12 // query_bytes))
    packed = store.put(_packed(asked, blocks), "queries")
    names = ("ids", "lengths", "term", "check", "df")

    def run(batches, block):
        asked = {c: np.frombuffer(v, _BLOCK[c]) for c, v in block.value.items()}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                lists = [row.column(c).flatten().to_numpy() if c != "ids" else row.column(c).flatten().fill_null(NO_ID).to_numpy() for c in names]
                shard = Shard(*lists, *(np.frombuffer(row.column(c)[0].as_buffer(), np.int32) for c in ("docs", "tfs")), mean)
                found, queries = shard.search(asked, k), asked["ids"]
                for start in range(0, len(found), PART):
                    some = found[start : start + PART]
                    q = np.repeat(queries[start : start + PART], [len(p) for p, _ in some])
                    d, x = shard.ids[np.concatenate([p for p, _ in some])], np.round(np.concatenate([x for _, x in some]), 9)
                    best, _ = _best(q, d, x, k)
                    yield packed_row(start // PART, row.column("shard")[0].as_py(), q[best], d[best], x[best])
                del shard, found

    def packed_row(part: int, shard: int, q: np.ndarray, d: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in (q, d, x))], ["part", "shard", "queries", "docs", "scores"])

    def fewer(table: pa.Table) -> pa.Table:
        q, d, x = _unpacked(table)
        best, _ = _best(q, d, x, k)
        return pa.Table.from_batches([packed_row(table.column("part")[0].as_py(), table.column("shard")[0].as_py(), q[best], d[best], x[best])])

    def last(table: pa.Table) -> pa.Table:
        q, d, x = _unpacked(table)
        best, rank = _best(q, d, x, k)
        return pa.table({"query_id": pa.array(q[best]), "rank": pa.array(rank.astype(np.int32)), "doc_id": pa.array(d[best], mask=d[best] == NO_ID), "score": pa.array(x[best])})

    def send(block: int):
        """One block goes to every task: its terms and codes, at most some QUERY_BYTES."""
        row = packed.where(F.col("block") == block).first()
        return spark.sparkContext.broadcast({c: bytes(row[c]) if row else b"" for c in _BLOCK})

    def best_of(sent) -> DataFrame:
        """The best of a block of queries: what a shard finds for PART queries is one row, and rows are merged in two steps where shards are many."""
        schema = "part int, shard long, queries binary, docs binary, scores binary"
        found = index.mapInArrow(B.released(lambda batches: run(batches, sent)), schema)
        if whole["shards"] > MERGED:
            found = found.withColumn("shard", F.pmod(F.xxhash64("shard"), F.lit(int(whole["shards"] ** 0.5)))).groupBy("part", "shard").applyInArrow(fewer, schema)
        return found.groupBy("part").applyInArrow(last, "query_id long, rank int, doc_id long, score double")

    if blocks == 1:
        return best_of(send(0))
    for block in range(blocks):
        sent = send(block)
        best_of(sent).write.mode("append").parquet(f"{store.path}/found")
        sent.destroy()  # or executors keep every block
    return spark.read.schema("query_id long, rank int, doc_id long, score double").parquet(f"{store.path}/found")
