"""Alignment of two tokenizers against the two libraries, token by token."""

import hashlib
import json
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from topicloom.llm import queries, token_alignment

SCHEMA = "doc_id long, text string, chunk long, stripe int, docs string"
TEXTS = [
    "The quick brown fox", "the  quick\n\nbrown\tfox ", "", None, " ", "naïve café 中文字符 émigré", "x" * 4000, "1234567890 " * 300, "a ▁ b", "<|endoftext|> <s> </s> <0x41> <unk>",
    "emoji 😀😀 and ﬁ ligature", "\u0000 nul", "don't we'll I've", "The quick brown fox", "  no-break", "é combining", "word " * 3000, "​zero width", "Ａ full width",
]


@pytest.fixture(scope="module")
def pair():
    return token_alignment.Pair.read(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def plainly(rows):
    """The results by loops over tokens, with nothing but the two libraries: a list of (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
    a_coder = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_coder.encode_special_tokens = True
    b_coder = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = token_alignment._byte_of_letter()
    a_bytes = {i: bytes(letters[c] for c in t) for t, i in a_coder.get_vocab().items() if i != 50256}

    def b_bytes(i):
        p = b_coder.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_coder.is_byte(i) else p.replace("▁", " ").encode()

    found, counts = [], Counter()
    for doc_id, text in rows:
        whole = (" " + (text or "")).encode()
        a, b = (a_coder.encode(" " + text, add_special_tokens=False).ids, b_coder.encode(text)) if text else ([], [])
        ab, bb = [a_bytes[i] for i in a], [b_bytes(i) for i in b]
        if not text or b"".join(ab) != whole or b"".join(bb) != whole:
            a = b = ab = bb = []
        sa, sb = ([(end - len(x), end) for x, end in zip(xs, accumulate(map(len, xs)), strict=True)] for xs in (ab, bb))
        links, j = [], 0
        for x, (start, end) in zip(a, sa, strict=True):
            while sb[j][1] <= start:
                j += 1
            k = j
            while k < len(sb) and sb[k][0] < end:
                links.append((x, b[k]))
                k += 1
        groups, before = [], 0
        for cut in sorted({e for _, e in sa} & {e for _, e in sb}):
            of = [",".join(str(x) for x, (_, e) in zip(ids, spans, strict=True) if before < e <= cut) for ids, spans in ((a, sa), (b, sb))] if len(a) < 500 else None
            groups.append("|".join(of) if of else None)
            before = cut
        counts.update(links)
        found.append((doc_id, len(a), len(b), len(groups), links, ";".join(groups) if None not in groups else None))
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [(d, na, nb, ng, len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), g) for d, na, nb, ng, links, g in found]


def agrees(got, want):
    got, want = ([x[0] is None, *x] for x in got), ([x[0] is None, *x] for x in want)
    for g, w in zip(sorted(got, key=repr), sorted(want, key=repr), strict=True):
        assert g[:8] == w[:8] and (w[8] is None or g[8] == w[8])


@pytest.mark.parametrize("split", [{}, {"chunk_bytes": 3000, "part": 2}])
def test_link_counts(spark, pair, split):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[5]), (None, "a null id"), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA).repartition(3)
    got = token_alignment.link_counts(docs, pair, **split)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    agrees([tuple(r) for r in got.collect()], plainly(rows))


def test_align_gives_ids_and_groups(spark, pair):
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in enumerate(TEXTS)], SCHEMA)
    want = {w[0]: w for w in plainly(enumerate(TEXTS))}
    for r in token_alignment.align(docs, pair).collect():
        assert (len(r.a), len(r.b), len(r.groups)) == want[r.doc_id][1:4]
        a, b, told = iter(r.a), iter(r.b), []
        for g in r.groups:
            assert g.a and g.b
            told.append(",".join(str(next(a)) for _ in range(g.a)) + "|" + ",".join(str(next(b)) for _ in range(g.b)))
        assert want[r.doc_id][7] in (None, ";".join(told))


def test_empty(spark, pair):
    assert token_alignment.link_counts(spark.createDataFrame([], SCHEMA), pair).count() == 0
    assert [tuple(r) for r in token_alignment.link_counts(spark.createDataFrame([(1, None, 1, 1, ""), (1, "", 1, 1, "")], SCHEMA), pair).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


def test_a_vocabulary_not_in_the_order_of_its_merges(spark, pair):
    """The other way to encode gives the same ids where ranks say the same."""
    about = json.loads(pair.a)
    about["normalizer"] = {"type": "NFC"}
    own = token_alignment.Pair(json.dumps(about), pair.b)
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in enumerate(TEXTS[:6] + ["é"])], SCHEMA)
    one, two = ({r.doc_id: tuple(r) for r in token_alignment.link_counts(docs, p).collect()} for p in (pair, own))
    assert {k: v for k, v in one.items() if k < 6} == {k: v for k, v in two.items() if k < 6} and two[6][1:3] == (0, 0) != one[6][1:3]


def test_query_is_the_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.op12_token_alignment(spark, d).collect()}
    want = plainly(rows)
    assert len(got) == len(want) == len(rows)
    for w in want:
        r = got[w[0]]
        assert tuple(r)[:7] == w[:7]
        if w[7] is not None:
            assert r.groups_sha256 == (hashlib.sha256(w[7].encode()).hexdigest() if w[7] else "")
