"""C-value counts: texts are taken apart once, and a term's rows meet once."""

import math
from collections import Counter, defaultdict

import pytest

from topicloom.operators import dtm

ROWS = [(1, "aa bb cc dd"), (2, "aa bb cc"), (2, "bb cc dd ee"), (3, "ee ee ee ee"), (None, "aa bb"), (None, "bb aa"), (4, None), (5, ""), (6, "xx yy xx yy"), (7, "dd")]


def _plain(most, min_freq, threshold, min_df, share):
    rows = Counter()
    for i, text in ROWS:
        words = (text or "").split()
        rows.update((i, " ".join(words[k : k + n])) for n in range(1, most + 1) for k in range(len(words) - n + 1))
    df, freq, outer = Counter(t for _, t in rows), Counter(), defaultdict(list)
    for (_, t), n in rows.items():
        freq[t] += n
    freq = {t: f for t, f in freq.items() if " " in t and f >= min_freq}
    for t, f in freq.items():
        words = t.split()
        for n in range(2, len(words)):
            for k in range(len(words) - n + 1):
                outer[" ".join(words[k : k + n])].append(f)
    score = {t: math.log2(len(t.split())) * (f - (sum(outer[t]) / len(outer[t]) if t in outer else 0)) for t, f in freq.items()}
    terms = {t for t, s in score.items() if s >= threshold}
    known = {t for t, d in df.items() if min_df <= d <= int(share * len(ROWS))}
    return {k: n for k, n in rows.items() if k[1] in known and (not terms or " " not in k[1] or k[1] in terms)}


@pytest.mark.parametrize("options", [(2, 2, 0.0, 2, 0.95), (2, 1, 3.0, 1, 0.35), (2, 9, 0.0, 1, 1.0), (3, 2, 0.0, 2, 0.95), (4, 2, 1.0, 1, 0.95)])
def test_cvalue_dtm(spark, options):
    most, min_freq, threshold, min_df, share = options
    got = dtm.cvalue_dtm(spark.createDataFrame(ROWS, "doc_id long, text string"), most, min_freq, threshold, min_df=min_df, max_df_frac=share).collect()
    assert {(r.doc_id, r.term): r.n for r in got} == _plain(*options)
    assert len(got) == len({(r.doc_id, r.term) for r in got})


def test_cvalue_dtm_reads_texts_once(spark, monkeypatch):
    """Texts are exchanged by document and rows by term, each once, in parts that grow with the texts; one table is written."""
    seen, write = [], dtm.written
    monkeypatch.setattr(dtm, "written", lambda df, name: seen.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    monkeypatch.setattr(dtm, "PART_BYTES", 8, raising=False)
    dtm.cvalue_dtm(spark.createDataFrame(ROWS, "doc_id long, text string"), 2)
    assert len(seen) == 1
    size = sum(len(t or "") for _, t in ROWS)
    assert "hashpartitioning(doc_id#" in seen[0] and seen[0].count("Exchange hashpartitioning") == 2 and f", {size * 2 // 8 + 1}), REPARTITION_BY_NUM" in seen[0]
