"""The registered queries and the pipeline's stages, on a small folder of tables, against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from topicloom.llm import byte_bpe, compression_classifier, jaccard_join, pii, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, word string"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    """Prose, exact and near copies, shared passages, personal data, junk, nulls, empty and very long texts, ties."""
    r = random.Random(12)
    vocab = ["".join(r.choice(["an", "ther", "ing", "e", "st", "on", "ou", "le"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    texts = [prose(r.randint(5, 160)) for _ in range(60)]
    shared = prose(110)
    texts += [f"{prose(20)} {shared} {prose(15)}" for _ in range(4)]
    texts += [texts[0], texts[0], texts[1].upper(), texts[2] + " more", texts[3].replace(" ", "\n", 3)]
    for k in range(6):
        words = texts[5].split() * 3
        words[k * 7] = "changed"
        texts.append(" ".join(words))
    texts += ["mail a.b@c-d.org or +1 (555) 010-9999, host 10.1.2.255, card 4111 1111 1111 1111", "call me at (555) 123-4567 now", "10.1.2.256 and 4111111111111112"]
    texts += ["spam " * 400, "### $$$ " * 60, "x" * 5000, prose(4000), "", None, "   ", "é中文 😀 it's  12", None]
    return [(i, t, "en", ["web", "books", None, "code"][i % 7 % 4], len(t or ""), 7, "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(not (t or "").startswith(("spam", "###", "x"))), 0) for i, t, *_ in rows if i % 2 == 0 or (t or "").startswith(("spam", "###"))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    chats = [(1, 0, "user", "hi <there> #1\\n"), (1, 1, "assistant", "x" * 700), (2, 0, "system", None), (2, 1, "user", ""), (2, 2, "assistant", "### Assistant: </turn>\n"), (2, 3, "assistant", "😀é"), (5, 1, "assistant", "late"), (5, 0, "user: x", "early")]
    spark.createDataFrame(chats, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def shingles(text, n):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def components(texts, n, num):
    """The least index that links reach from each text."""
    sets, root = [shingles(t, n) for t in texts], list(range(len(texts)))

    def top(x):
        return x if root[x] == x else top(root[x])

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(texts))], sets


def test_op1(spark, folder, rows):
    want, sets = components([x[1] for x in rows], 3, 90)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in queries.op1_jaccard_join(spark, folder).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in range(len(rows))}


def test_op2(spark, folder, rows):
    sizes = [len(WORD.findall(x[1] or "")) for x in rows]
    per = Counter()
    for x, n in zip(rows, sizes, strict=True):
        per[x[3]] += n
    names = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:  # water-filling: whoever is above its cap stops there, the rest share again
        left = 1.5 * sum(per.values()) - sum(2 * per[s] for s in full)
        rest = sum(weight[s] for s in names if s not in full)
        target = {s: 2.0 * per[s] if s in full else left * weight[s] / rest for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * per[s]}
        if not over:
            break
        full |= over
    got = queries.op2_mixing(spark, folder).collect()
    assert sorted((x.doc_id, x.size, x.source_size) for x in got) == [(i, n, per[rows[i][3]]) for i, n in enumerate(sizes)]
    taken = Counter()
    for x in got:
        assert x.target == pytest.approx(target[rows[x.doc_id][3]]) and x.taken <= 2 * x.size
        taken[rows[x.doc_id][3]] += x.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert sorted(map(str, got)) == sorted(map(str, queries.op2_mixing(spark, folder).collect()))


def own_encoding():
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op3(spark, folder, rows):
    own = own_encoding()
    got = {x.doc_id: tuple(x)[1:] for x in queries.op3_byte_bpe(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    for i, text, *_ in rows:
        ids = own.encode_ordinary(text or "")
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(text or ""))


def plain_spans(t):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in patterns.items():
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_op4(spark, folder, rows):
    got = {x.doc_id: x for x in queries.op4_pii(spark, folder).collect()}
    added = 0
    for i, text, *_ in rows:
        base = plain_spans(text or "")
        x, joined = got[i], ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [x[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert x.base_sha256 == sha(joined)
        spans = x.spans.split(",") if x.spans else []
        assert set(joined.split(",")) - {""} <= set(spans)
        added += len(spans) - len(base)
    assert added >= 1


def test_op5(spark, folder, rows):
    got = {x.doc_id: x for x in queries.op5_compression_classifier(spark, folder).collect()}
    assert sorted(got) == list(range(len(rows)))
    for i, x in got.items():
        assert x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3)


def test_op7(spark, folder, rows):
    data = [(x[1] or "").encode() for x in rows]
    seen = Counter(b[i : i + 400] for b in data for i in range(len(b) - 399))
    got = {x.doc_id: tuple(x)[1:] for x in queries.op7_repeated_spans(spark, folder).collect()}
    hit = 0
    for k, b in enumerate(data):
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        hit += any(gone)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        assert got[k][:4] == (len(b), sum(gone), len(runs), sha(kept))
        assert got[k][4:6] == (bool(runs), ",".join(f"{x}:{y}" for x, y in runs))
        assert got[k][6] == (kept.decode("utf-8", "replace") if runs else None)
    assert hit >= 8


def test_op8(spark, folder, rows):
    got = {x.doc_id: x for x in queries.op8_quality_rules(spark, folder).collect()}
    for i, text, *_ in rows:
        t = text or ""
        w, seen, dup = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        cover = {j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover))
        assert x.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (x.base_failed and x.kept)
    assert sum(x.kept for x in got.values()) > 50


def test_op8_bands_reject(spark):
    """The bands, without the base rule's help, reject most of what is labelled bad and next to nothing of the rest."""
    sf = "/root/testdata/sf0.1"
    found = queries.op8_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    bad, good = [x.kept for x in found if x.quality == 0], [x.kept for x in found if x.quality == 1]
    assert sum(bad) < 0.5 * len(bad) and sum(good) > 0.97 * len(good), (sum(bad), len(bad), sum(good), len(good))


def test_op9(spark, folder, rows):
    got = queries.op9_sharding(spark, folder).collect()
    assert len(got) == len(rows) and {x.law for x in got} == {"bytes"}
    per, total = Counter(), 0
    texts = {x[0]: x[1] or "" for x in rows}
    for x in got:
        raw = texts[x.doc_id].encode()
        assert (x.size, x.text_crc32, x.grown_shard) == (len(raw) + 1, zlib.crc32(raw), None) and 0 <= x.shard < 16
        per[x.shard] += x.size
        total += x.size
    for s in range(16):
        assert sorted(x.slot for x in got if x.shard == s) == list(range(sum(x.shard == s for x in got)))
    # No shard is further from its share than the largest row.
    assert max(abs(per[s] - total / 16) for s in range(16)) <= max(x.size for x in got)


def test_op9_law_and_equal_texts(spark):
    got = queries.op9_sharding(spark, "/root/testdata/sf0.01").collect()
    per, by_text = Counter(), {}
    for x in got:
        per[x.shard] += x.size
        by_text.setdefault((x.text_crc32, x.size), set()).add(x.shard)
    mean = sum(per.values()) / 16
    assert len(per) == 16 and max(abs(v - mean) for v in per.values()) < 0.03 * mean
    assert sum(len(s) == 1 for s in by_text.values()) >= 0.99 * len(by_text)


def test_op10(spark, folder):
    turns = {}
    for x in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        turns.setdefault(x.conv_id, []).append((x.turn, x.role, x.text or ""))
    said = "\\### Assistant: </turn> ok"
    turns[-7] = [(0, "user", said), (1, "assistant", said)]
    got = {x.conv_id: x for x in queries.op10_chat(spark, folder).collect()}
    assert sorted(got) == sorted(turns)
    for conv, own in turns.items():
        own = sorted(own)
        learned = "".join(t for _, role, t in own if role == "assistant")
        x = got[conv]
        assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == (len(own), sha("".join(f"{r}\n{t}\n" for _, r, t in own)), len(learned), sha(learned))
        assert x.formatted_chars > sum(len(t) for *_, t in own)


def stage(spark, name, docs, folder):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, folder)


def test_pipeline_stages(spark, folder, rows, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").drop("size", "word")
    columns = docs.columns

    labels = spark.read.parquet(f"{folder}/labels.parquet").where("crc32(cast(doc_id as string)) % 5 <> 0")
    scores = {x.doc_id: x.score for x in compression_classifier.score(docs, compression_classifier.fit(docs, labels)).collect()}
    kept = stage(spark, "quality", docs, folder)
    assert kept.columns == columns and sorted(x.doc_id for x in kept.collect()) == sorted(i for i, s in scores.items() if s >= 0.3)

    # The other stages on all documents, so that each case is met.
    one = stage(spark, "near_duplicates", docs, folder)
    want, sets = components([x[1] for x in rows], 5, 80)
    assert one.columns == columns and sorted(x.doc_id for x in one.collect()) == [i for i in range(len(rows)) if want[i] == i]

    clean = stage(spark, "personal_data", docs, folder)
    detector = pii.fit()
    assert clean.columns == columns
    for x in clean.collect():
        text = rows[x.doc_id][1]
        assert x.text == (None if text is None else pii.redacted(text, detector.spans(text)[1]))
        assert x.text is None or "a.b@c-d.org" not in x.text

    mixed = stage(spark, "mix_sources", docs, folder)
    plan = {x.doc_id: x for x in queries.op2_mixing(spark, folder).collect()}
    taken = Counter()
    for x in mixed.collect():
        taken[x.doc_id] += len(WORD.findall(x.text))
        assert rows[x.doc_id][1].startswith(x.text) and x.n_chars == len(x.text)
    assert mixed.columns == columns and {i: t for i, t in taken.items() if t} == {i: x.taken for i, x in plan.items() if x.taken}

    own = own_encoding()
    for x in stage(spark, "tokens", docs, folder).collect():
        ids = own.encode_ordinary(rows[x.doc_id][1] or "")
        assert (x.ids, x.n_tokens, x.ids_sha256, x.decoded_sha256) == (ids, len(ids), sha(",".join(map(str, ids))), sha(rows[x.doc_id][1] or ""))


def test_pipeline_run(spark, folder):
    """All stages in turn, each on what the one before has kept; an empty table goes through as well."""
    out = corpus_pipeline.run(spark, folder).collect()
    ids = {x.doc_id for x in out}
    assert ids
    assert len({0, 64, 65} & ids) <= 1  # exact copies: one at most


def test_pipeline_on_empty_tables(spark, tmp_path):
    path = str(tmp_path / "empty")
    spark.createDataFrame([], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_hot_bucket(spark):
    """More classes share a prefix than the join looks at pair by pair: leaders and components give the same as all pairs."""
    r = random.Random(3)
    base = [f"w{r.randint(0, 999)}" for _ in range(120)]
    texts = []
    for _ in range(jaccard_join.HOT * 2 + 9):
        w = list(base)
        w[r.randrange(60, 120)] = f"x{r.randint(0, 10 ** 6)}"
        texts.append(" ".join(w))
    texts += [" ".join(base[:60] + [f"y{r.randint(0, 10 ** 6)}" for _ in range(60)]) for _ in range(40)]
    want, _ = components(texts, 3, 90)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [x.component_id for x in jaccard_join.near_duplicate_components(docs, words=3, num=90).orderBy("doc_id").collect()] == want
