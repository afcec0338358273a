"""The corpus operators against plain versions on small fixtures, with nulls, ties, repeats and long texts."""

import gc
import hashlib
import json
import random
import re
import time
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F

from topicloom.llm import bm25, byte_bpe, chat, compression_classifier, jaccard_join, mixing, pii, quality_rules, queries, repeated_spans, sharding
from topicloom.llm.store import hand_back

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, rank int"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    words = ["alpha", "Beta", "gamma", "delta", "été", "eps", "zeta", "eta", "theta", "x1", "中文", "kappa"]
    base = [" ".join(r.choice(words) + str(r.randint(0, 99)) for _ in range(r.randint(20, 120))) for _ in range(12)]
    out = list(base)
    for t in base * 3:
        w = t.split(" ")
        w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [base[0], base[0].upper(), "", None, "   ", "one", "one two", "\n".join([base[1]] * 4), "a" * 3000, "word " * 5000, base[2] + "\n" + base[3]]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["s1", "s2", None][i % 3], 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, n):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80)])
def test_jaccard_join(docs, texts, n, num):
    sets = [shingles(t, n) for t in texts]
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    want = {i: (len(s), top(i)) for i, s in enumerate(sets)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicate_components(docs, words=n, num=num).collect()}
    assert got == want
    kept = sorted(r.doc_id for r in jaccard_join.keep_one(docs, words=n, num=num).collect())
    assert kept == sorted({i for i in want if want[i][1] == i})


@pytest.mark.parametrize("block", [jaccard_join.BLOCK, 5000])
def test_jaccard_links(spark, block):
    """All links of a large group of near copies are counted, not those alone that make it one component."""
    r = random.Random(8)
    base = [f"w{r.randint(0, 999)}" for _ in range(300)]
    texts = []
    for k in range(90):
        w = list(base)
        for _ in range(1 + k % 3):
            w[r.randrange(len(w))] = f"x{r.randint(0, 99)}"
        texts.append(" ".join(w))
    texts += [texts[0], texts[7], "lone words that link to nothing at all", "", None]
    sets = [shingles(t, 3) for t in texts]
    link = lambda a, b: a and b and a != b and 100 * len(a & b) >= 90 * len(a | b)
    classes = set(sets)
    want = {i: sum(bool(link(s, t)) for t in classes) for i, s in enumerate(sets)}
    assert max(want.values()) > 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: x.n_links for x in jaccard_join.near_duplicate_components(docs, words=3, num=90, block=block).collect()} == want


def test_keep_one_with_odd_ids(spark):
    rows = [(1, "a b c d e f g", "x", 1), (1, "a b c d e f g", "y", 1), (None, "a b c d e f g", "z", 1), (3, None, "e", 1), (3, "", "e", 1), (4, "k l m n o p q", "u", 1), (4, "z x c v b n m", "u", 1), (5, "z x c v b n m", "u", 1)]
    kept = sorted((r.doc_id, r.text or "") for r in jaccard_join.keep_one(spark.createDataFrame(rows, SCHEMA)).collect())
    assert kept == [(1, "a b c d e f g"), (3, ""), (3, ""), (4, "k l m n o p q"), (4, "z x c v b n m")]
    clash = spark.createDataFrame([(r[0], r[1], "d", 1, "r") for r in rows], "doc_id long, text string, __digest string, id int, row string")
    kept = jaccard_join.keep_one(clash)
    assert kept.columns == clash.columns and kept.count() == 5 and kept.where("__digest = 'd' and id = 1 and row = 'r'").count() == 5


@pytest.mark.parametrize("hot,piece", [(2000, 1 << 23), (2, 500)])
def test_repeated_spans(docs, texts, hot, piece):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 400] for b in data for i in range(len(b) - 399))
    want = {}
    for k, b in enumerate(data):
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[k] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept))
    found = repeated_spans.remove_repeated(docs, hot=hot, piece=piece)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()} == want


def test_repeated_spans_with_repeated_and_null_ids(spark):
    """Rows of one id with other texts, as the last of a batch too, lose none of what was gathered before them."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
    shared = [" ".join(word() for _ in range(70)) for _ in range(4)]
    texts = [" ".join(word() for _ in range(40)) + shared[i % 4] + word() for i in range(16)] + [None, "", "short"]
    ids = [None if i % 3 == 0 else 5 if i % 3 == 1 else i for i in range(len(texts))]
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 400] for b in data for i in range(len(b) - 399))
    want = []
    for k, b in zip(ids, data, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        want.append((k, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    assert sum(w[2] > 0 for w in want) == 16
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    for hot in (2000, 2):
        found = repeated_spans.remove_repeated(docs, hot=hot).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found), key=str) == sorted(want, key=str)


def test_quality_counts(docs, texts):
    def plain(t):
        t = t or ""
        w, lines, seen, dup = WORD.findall(t), t.split("\n"), set(), 0
        for line in lines:
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)

    got = {r.doc_id: tuple(r)[1:] for r in quality_rules.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("how", [{}, {"longest": 6, "chunk_bytes": 500, "bucket_bytes": 4000}, {"spaced": False, "chunk_bytes": 3000}])
def test_bpe(spark, docs, texts, how):
    """Ids and bytes equal the tokenizer library's on each branch: folded and long words, stretches and whole texts, many chunks and one."""
    r = random.Random(8)
    parts = ["a", "b", " ", "  ", "\n", "\t", "\u00a0", "1", "23", "'s", "'", "!!", "\u00e9", "\u4e2d\u6587", "\x1c", "\x85", "word", "\U0001f600", "x" * 140]
    more = texts + ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(150)]
    table = spark.createDataFrame(list(enumerate(more)), "doc_id long, text string").repartition(3)
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = byte_bpe.decode(byte_bpe.encode(table, ranks, public_tokenizers.PATTERN, **how), ranks).collect()
    assert sorted(x.doc_id for x in found) == list(range(len(more)))
    for got in found:
        text = more[got.doc_id] or ""
        assert got.ids == own.encode_ordinary(text)
        assert bytes(got.decoded) == text.encode()


def test_bpe_edges(spark):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    odd = spark.createDataFrame([(None, "a", "x", 1), (None, "a", "x", 1), (3, None, None, 2)], "doc_id int, text string, words string, ids int")
    assert sorted((x.doc_id is None, len(x.ids)) for x in byte_bpe.encode(odd, ranks, public_tokenizers.PATTERN).collect()) == [(False, 0), (True, 1), (True, 1)]
    coded = spark.createDataFrame([([104, 105], "kept"), (None, None), ([], None)], "ids array<int>, decoded string")
    pieces = {v: k for k, v in ranks.items()}
    assert [None if x.decoded is None else bytes(x.decoded) for x in byte_bpe.decode(coded, ranks).collect()] == [pieces[104] + pieces[105], None, b""]
    with pytest.raises(Exception, match="no piece"):
        byte_bpe.decode(spark.createDataFrame([([1 << 20],)], "ids array<int>"), ranks).collect()
    with pytest.raises(ValueError, match="without a rank"):
        byte_bpe.encode(odd, {b"a": 0}, public_tokenizers.PATTERN)


def test_bpe_rank_map(spark):
    """One number a place has the rank of each pair, and of no other; words that a part's number has no room for are merged elsewhere."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    held = json.loads(byte_bpe._rank_map(ranks))
    rows, pairs = held["rows"], held["pairs"]
    assert sum(map(len, held.values())) == 256 + len(rows) + len(pairs)
    piece, r = {v: k for k, v in ranks.items()}, random.Random(5)
    some = [(ranks[t[:i]], ranks[t[i:]]) for t in ranks for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    for a, b in some + [(r.randrange(len(rows)), r.randrange(len(rows) + 1)) for _ in range(20_000)]:
        found = pairs[(rows[a] + b) % len(pairs)]
        assert (found % (1 << byte_bpe.ID_BITS) if found >> byte_bpe.ID_BITS == a + 1 else None) == (ranks.get(piece[a] + piece[b]) if b in piece else None)
    with pytest.raises(ValueError, match="over"):
        byte_bpe._rank_map({**{bytes([b]): b for b in range(256)}, b"ab": 1 << byte_bpe.ID_BITS})
    table = spark.createDataFrame([(1, "x" * 4200)], "doc_id int, text string")
    assert tuple(byte_bpe.encode(table, ranks, public_tokenizers.PATTERN, longest=10_000).first().ids) == byte_bpe.merge(b"x" * 4200, ranks)


def test_bpe_joined(spark):
    table = spark.createDataFrame([([],), ([7],), ([0, 12, 50_255],), (None,)], "ids array<int>")
    assert [x[0] for x in table.select(byte_bpe.joined(table.ids)).collect()] == ["", "7", "0,12,50255", None]


def test_bpe_gather_is_bounded():
    """What a worker holds to put ids together is what it puts together and some MB, however many there are."""
    start, size = np.arange(400_000)[::-1] * 5, np.arange(400_000) % 11
    size[7] = 500_000
    source = np.arange(3_000_000, dtype=np.int32)
    tracemalloc.start()
    got = byte_bpe._gather(source, start.clip(0, 2_400_000), size)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == [x for a, n in zip(start.clip(0, 2_400_000).tolist(), size.tolist(), strict=True) for x in range(a, a + n)]
    assert most < got.nbytes + (26 << 20)
    assert len(byte_bpe._gather(source, start[:0], size[:0])) == 0


def test_small_chunks_share_buckets(spark, monkeypatch):
    """Chunks of the pipeline's size bound a worker's memory; they make no more buckets, each of which is a task, than large ones."""
    made, put = [], byte_bpe.Store.put_bucketed
    monkeypatch.setattr(byte_bpe.Store, "put_bucketed", lambda self, df, name, buckets, by: made.append((buckets, put(self, df, name, buckets, by))) or made[-1][1])
    table = spark.createDataFrame([(i, f"word{i} " * 20) for i in range(200)], "doc_id int, text string").coalesce(1)
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    assert byte_bpe.encode(table, ranks, public_tokenizers.PATTERN, chunk_bytes=2000).count() == 200
    assert made[0][0] == 1 and made[0][1].count() > 5


def test_pii_base():
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def plain(t):
        out = []
        for kind, p in patterns.items():
            for m in re.finditer(p, t):
                digits = re.sub("[^0-9]", "", m.group())
                if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                    continue
                out.append((kind, *m.span()))
        return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))

    r = random.Random(5)
    for _ in range(4000):
        t = "".join(r.choice(["a", "b.", "@", "1", "22", ".", "+", "-", " ", "(", "255", "00012", "4111111111111111", "é", "%"]) for _ in range(r.randint(0, 30)))
        assert pii.base_spans(t) == plain(t)
    detector = pii.fit()
    assert detector.spans("call me at (555) 123-4567 now")[1] == [("phone", 11, 25)]
    assert pii.redacted("mail a@b.org, 10.0.0.1", detector.spans("mail a@b.org, 10.0.0.1")[1]) == "mail [EMAIL], [IP]"
    held = pii._examples(99, 1500)
    taken = np.array([detector.scores(t, [s])[0] >= detector.thresholds[s[0]] for t, s, _ in held])
    y = np.array([y for *_, y in held])
    assert y[taken].mean() > 0.95 and taken[y == 1].mean() > 0.8
    # Calibrated: of candidates with like scores, about that share is personal.
    p = np.array([detector.scores(t, [s])[0] for t, s, _ in held])
    assert abs(p.mean() - y.mean()) < 0.05


#: Written by hand, with names, wording and formats that the grammar can not make: (text, what is personal in it, or None).
BY_HAND = [
    ("Please mail the signed form to margaret.hollis (at) riverbend (dot) org before Friday.", "margaret.hollis (at) riverbend (dot) org"),
    ("For press questions contact j.okafor [at] northlight [dot] net.", "j.okafor [at] northlight [dot] net"),
    ("Schreiben Sie an empfang(at)stadtwerke-ulm.de oder kommen Sie vorbei.", "empfang(at)stadtwerke-ulm.de"),
    ("Write to tomas.varga at postfach dot com if the parcel is late.", "tomas.varga at postfach dot com"),
    ("Reach the warden: warden_3[at]hillhouse.edu", "warden_3[at]hillhouse.edu"),
    ("Our fax is (312) 867-5309 and it still works.", "(312) 867-5309"),
    ("Call 0171 4455 9821 after six, please.", "0171 4455 9821"),
    ("Tel. 030/9018203, ask for Petra.", "030/9018203"),
    ("my mobile: 646-201-7784 (no texts)", "646-201-7784"),
    ("The login came from host 2001:0db8:85a3:1f3c:9d2e:8a2e:0370:7334 at noon.", "2001:0db8:85a3:1f3c:9d2e:8a2e:0370:7334"),
    ("Server 10[.]24[.]7[.]131 was down again.", "10[.]24[.]7[.]131"),
    ("She paid with card 4539.1488.0343.6467 yesterday.", "4539.1488.0343.6467"),
    ("Visa 4485/2757/4230/8327 expires soon.", "4485/2757/4230/8327"),
    ("We stayed at home and at the lake. The dot on the map was wrong.", None),
    ("He laughed at it. Of course everyone did.", None),
    ("Chapter 3, section 1 . 4 . 2 . 7, explains the rule.", None),
    ("Upgrade to version 12.4.0.19 as soon as you can.", None),
    ("ISBN 978-0-3064-0615-7 is out of print.", None),
    ("Order 4471902288365510 has shipped.", None),
    ("The ticket 1234-5678-9012-3456 was closed.", None),
    ("Between 1914-1918 and 1939-1945 the mill stood still.", None),
    ("Meet on 12.11.2021 at ten.", None),
    ("Pages 120-138 were missing.", None),
    ("The total was 120.455.300 in the end.", None),
    ("Mile 204 880 of the survey is mud.", None),
    ("The clip runs 10:22:35:07 in all.", None),
    ("Part no. 555-1203 fits the older pump.", None),
]


def test_pii_by_hand():
    """What the trees add to the base spans, on texts that have nothing to do with what they were fitted on."""
    detector = pii.fit()
    right = wrong = missed = 0
    for text, what in BY_HAND:
        base, every = detector.spans(text)
        added = [s for s in every if s not in base]
        at = text.find(what) if what else -1
        hit = [s for s in every if what and s[1] < at + len(what) and at < s[2]]
        right += bool(hit)
        missed += bool(what) and not hit
        wrong += len([s for s in added if s not in hit])
    assert right >= 9 and right / (right + wrong) >= 0.8, (right, wrong, missed)


def test_pii_frames(spark):
    docs = spark.createDataFrame([(1, "a@b.org and call me at (555) 123-4567 now", "x"), (1, "a@b.org and call me at (555) 123-4567 now", "x"), (None, None, None), (3, "", "y")], "doc_id long, text string, spans string")
    found = sorted(((r.doc_id, [tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in pii.find_pii(docs).collect()), key=str)
    one = (1, [("email", 0, 7)], [("email", 0, 7), ("phone", 23, 37)])
    assert found == [one, one, (3, [], []), (None, [], [])]
    assert sorted(((r.doc_id, r.text, r.spans) for r in pii.redact(docs).collect()), key=str) == sorted([(1, "[EMAIL] and call me at [PHONE] now", "x")] * 2 + [(None, None, None), (3, "", "y")], key=str)


def test_pii_candidates_without_a_gate():
    """Every match of the e-mail generator is a candidate."""
    r = random.Random(6)
    texts = ["jane.doe(AT)example.com", "jane [AT] example.org", "jane{at}example.com", "jane ( AT ) example.com", "jane at example dot com"]
    texts += ["".join(r.choice(["jo", "x.", "(", "[", "{", "at", "AT", ")", "]", "}", " ", " at ", "&#64;", "dot", "DOT", ".", "com"]) for _ in range(r.randint(3, 14))) for _ in range(3000)]
    found = [[s for s in pii.candidates(t) if s[0] == "email"] for t in texts]
    assert all(found[:5])
    assert found == [[("email", *m.span()) for m in pii._PROPOSE["email"].finditer(t)] for t in texts]


def test_mixing(docs, texts):
    plan = mixing.mix(docs).collect()
    assert len(plan) == len(texts)
    sizes, taken, target = Counter(), Counter(), {}
    for r in plan:
        assert r.size == len(WORD.findall(texts[r.doc_id] or "")) and r.taken <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert sorted(map(str, plan)) == sorted(map(str, mixing.mix(docs).collect()))
    mixed = mixing.materialize(docs, mixing.mix(docs)).collect()
    assert sum(len(WORD.findall(r.text)) for r in mixed) == sum(taken.values())
    clash = docs.withColumn("words", F.lit("w")).withColumn("size", F.lit(1)).withColumn("row", F.lit(2)).withColumn("times", F.lit(3))
    assert sorted(map(str, mixing.materialize(clash, mixing.mix(clash)).select("doc_id", "text").collect())) == sorted(str(r) for r in mixing.materialize(docs, mixing.mix(docs)).select("doc_id", "text").collect())


def test_mix_order(spark):
    """Any beginning of the mix, in the order of its slots, has the sources near their parts: the schedule makes that, not the totals."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"), F.repeat(F.lit("w "), (20 + F.col("id") % 60).cast("int")).alias("text"))
    plan = mixing.mix(docs).collect()
    total = sum(r.taken for r in plan)
    share = Counter()
    for r in plan:
        share[r.source] += r.taken / total
    mixed = sorted((slot, r.source, min(r.size, r.taken - i * r.size)) for r in plan for i, slot in enumerate(r.slots))
    assert sum(w for *_, w in mixed) == total and all(len(r.slots) == -(-r.taken // r.size) for r in plan)
    seen, done = Counter(), 0
    for k, (_, source, words) in enumerate(mixed):
        seen[source] += words
        done += words
        if k % 500 == 499:
            assert all(abs(seen[s] / done - share[s]) < 0.02 for s in share)


def test_sharding(docs, texts):
    rows = sharding.shard_by_bytes(docs, shards=4).collect()
    assert [r.size for r in sorted(rows, key=lambda r: r.doc_id)] == [len((t or "").encode()) + 1 for t in texts]
    for s in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))


def test_sharding_near_equal(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % 7 + 1).cast("int")).alias("text"))
    sums = [r["b"] for r in sharding.shard_by_bytes(docs, shards=8).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sums) == 8 and max(sums) < 1.05 * min(sums)


def test_chat(spark):
    odd = "\\### Assistant: </turn> ok"
    turns = [(1, 0, "user", odd), (1, 1, "assistant", odd), (2, 0, "user: x", None), (2, 1, "assistant", "a\\b<#"), (2, 1, "assistant", "again"), (None, 0, None, "y")]
    log = chat.messages_as_events(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    back = {r.conv_id: r for r in chat.read_back(chat.render(chat.reconstruct(log))).withColumn("learned", chat.masked_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", odd), ("assistant", odd)] and back[1].learned == odd
    assert [tuple(t) for t in back[2].turns] == [("user: x", ""), ("assistant", "a\\b<#"), ("assistant", "again")]
    assert back[2].learned == "a\\b<#again" and [tuple(t) for t in back[None].turns] == [("", "y")]
    events = [(1, 1, "message", 0, "user", "hi"), (1, 2, "message", 1, "assistant", "a"), (1, 3, "delta", 1, None, "b"), (1, 4, "message", 2, "user", "more"), (1, 5, "regenerate", 1, "assistant", None), (1, 6, "delta", 1, None, "new"), (1, 7, "edit", 0, "user", "hello"), (1, 8, "delta", 1, "assistant", "last")]
    folded = chat.reconstruct(spark.createDataFrame(events, "conv_id long, seq long, kind string, turn long, role string, text string")).first()
    assert [tuple(t) for t in folded.turns] == [("user", "hello"), ("assistant", "last")]


def test_chat_folds_finished_turns_with_later_events(spark):
    """Turns that repeat a number stay turns of their own in a log that goes on with other events."""
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "x"), (2, 0, "user", "x"), (2, 1, "assistant", "y")]
    log = chat.messages_as_events(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert {r.kind for r in log.collect()} == {"message", "delta", "edit", "regenerate"}
    more = spark.createDataFrame([(1, 9, "delta", 2, "user", "m"), (1, 10, "delta", 2, "user", "n"), (2, 9, "delta", 0, "user", "z")], "conv_id long, seq long, kind string, turn long, role string, text string")
    back = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.reconstruct(log.unionByName(more, allowMissingColumns=True)).collect()}
    assert back == {1: [("user", "q"), ("assistant", "a"), ("assistant", "b"), ("user", "mn")], 2: [("user", "xz"), ("user", "x"), ("assistant", "y")]}


def test_chat_fold_against_plain(spark):
    r = random.Random(9)
    rows, want = [], {}
    for conv in range(60):
        turns = {}
        for seq in range(r.randint(1, 40)):
            kind, turn, role, text = r.choice(["message", "delta", "delta", "edit", "regenerate"]), r.randint(0, 7), r.choice("ua"), r.choice("wxyz")
            rows.append((conv, seq, kind, turn, role, text))
            was = turns.get(turn)
            if kind in ("edit", "regenerate"):
                turns = {k: v for k, v in turns.items() if k < turn}
            if kind == "delta":
                turns[turn] = (was[0], was[1] + text) if was else (role, text)
            else:
                turns[turn] = (role if kind == "message" or not was else was[0], "" if kind == "regenerate" else text)
        want[conv] = [turns[k] for k in sorted(turns)]
    log = spark.createDataFrame(rows, "conv_id long, seq long, kind string, turn long, role string, text string")
    assert {x.conv_id: [tuple(t) for t in x.turns] for x in chat.reconstruct(log).collect()} == want


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op5_compression_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    good = [r.predicted for r in rows if r.quality == 1]
    assert np.mean(good) > 0.95
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9


@pytest.mark.parametrize("split", [{}, {"shard_bytes": 3000, "query_bytes": 2000}, {"shard_bytes": 1}])
def test_bm25(docs, texts, split):
    lower = [[w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(t or "")] for t in texts]
    n, mean = len(texts), sum(map(len, lower)) / len(texts)
    df = Counter(w for ws in lower for w in set(ws))
    want = {}
    for q in (0, 5, 40):
        scores = {}
        for i, ws in enumerate(lower):
            tf = Counter(ws)
            s = sum(np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in set(lower[q]) if w in tf)
            if s:
                scores[i] = round(s, 6)
        want[q] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5]
    got = {}
    for r in bm25.search(docs, docs.where("doc_id in (0, 5, 40)"), k=5, **split).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 6)))
    assert all([s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-6) for q in want)


def test_empty_tables(spark, empty):
    assert jaccard_join.near_duplicate_components(empty).count() == 0
    assert repeated_spans.remove_repeated(empty).count() == 0
    assert quality_rules.quality_rules(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert sharding.shard_by_bytes(empty).count() == 0
    assert bm25.search(empty, empty).count() == 0
    assert pii.find_pii(empty).count() == 0
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    assert byte_bpe.encode(empty, ranks, public_tokenizers.PATTERN).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert compression_classifier.score(empty, compression_classifier.fit(empty, labels)).count() == 0


def test_bands_of_all_good_rows(spark):
    """Every good row counts, also beyond some ten thousands: limits are the quantiles of all of them."""
    n = 44_000
    text = F.concat_ws(" ", *(F.substring(F.sha2(F.concat_ws("/", "id", F.lit(k)), 256), 1, 1 + (k * 7) % 23) for k in range(6)), F.repeat(F.lit("a b "), (F.col("id") % 40).cast("int")))
    docs = spark.range(n).select(F.when(F.col("id") % 11 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 13 > 0, text).alias("text")).unionByName(spark.createDataFrame([(1, ""), (2, "x y"), (2, "x y")], "doc_id long, text string"))
    good = docs.where("doc_id % 17 <> 3 or doc_id is null").select("doc_id")
    bands = quality_rules.fit_bands(docs, good)
    zip_ = zstandard.ZstdCompressor(level=3, write_content_size=False)
    raw = [r["text"].encode() for r in docs.where("doc_id % 17 <> 3 and text <> ''").collect()]
    size, ratio = np.array([len(x) for x in raw]), np.array([len(zip_.compress(x)) / len(x) for x in raw])
    assert len(raw) > 30_000
    first, measured = 0, 0
    for end, low, high in bands.limits:
        own = ratio[(size > first) & (size <= end)]
        if len(own) >= 50:
            assert (low, high) == pytest.approx((np.quantile(own, 0.002) * 0.995, np.quantile(own, 0.998) * 1.005), rel=1e-12)
            measured += 1
        first = end
    assert measured >= 3


def test_bands_count_every_repeat(spark):
    """Rows that repeat an id beyond some ten thousands are all counted: a rare kind among many equal rows moves a limit."""
    same = spark.range(90_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("one two three four five six seven eight nine ten").alias("text"))
    odd = spark.range(500).select(F.lit(2).cast("long").alias("doc_id"), F.repeat(F.lit("a"), 50).alias("text"))
    docs = same.unionByName(odd).coalesce(1)
    bands = quality_rules.fit_bands(docs, docs.select("doc_id"))
    zip_ = zstandard.ZstdCompressor(level=3, write_content_size=False)
    assert bands.limits[0][1] == pytest.approx(len(zip_.compress(b"a" * 50)) / 50 * 0.995, rel=1e-12)


def test_bm25_one_shard_a_file(spark, monkeypatch):
    """Shards of one task are not held together by Parquet's writer and reader, whatever their number."""
    folders = []
    put = bm25.Store.put

    def seen(self, df, name, *a, **b):
        out = put(self, df, name, *a, **b)
        folders.extend([out] * (name == "index"))
        return out

    monkeypatch.setattr(bm25.Store, "put", seen)
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit(f"w{k}-"), F.col("id") % (7 + k)) for k in range(6))).alias("text"))
    found = bm25.search(docs.coalesce(1), docs.where("doc_id % 50 = 0"), k=3, shard_bytes=2000)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, bm25.search(docs, docs.where("doc_id % 50 = 0"), k=3).collect()))
    files = [r["n"] for r in folders[0].groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(files) > 1 and max(files) == 1


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory is read from there")
def test_freed_memory_outside_the_heap_goes_back(spark):
    """What the driver's JVM freed outside its heap between blocks that are still in use goes back to the system."""
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()

    def held() -> int:
        return int(re.search(r"Anonymous: +(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) >> 10

    def collect() -> None:
        for _ in range(3):
            gc.collect()
            jvm.java.lang.System.gc()
            time.sleep(0.5)

    buffers = [jvm.java.nio.ByteBuffer.allocateDirect(1 << 16) for _ in range(3200)]
    buffers = buffers[::40]
    collect()
    before = held()
    hand_back(spark)
    assert held() < before - 60 and buffers
