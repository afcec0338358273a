"""Queries against their SQL on the smallest tables."""

import pytest

from tests.verify import compare, connect
from topicloom.plans import catalogue, catalogue_fits  # noqa: F401  the second adds to the first

SMALL = "/root/testdata/sf0.001"
#: The rest are compared by tests/verify.py, which takes minutes.
NAMES = [
    "dtm_df_filter", "ngrams_1_2", "cvalue_terms", "cvalue_dtm", "pos_dtm", "paragraph_split", "ctfidf_top_terms", "ctfidf_sqrt", "topic_info", "document_info",
    "find_topics_substring", "centroids", "transform_nearest", "zero_shot_assign", "reduce_outliers_emb", "reduce_outliers_ctfidf", "renumber_topics", "silhouette", "coherence_npmi",
    "ari", "compare_chi2", "global_chi2_statistic", "bin_timestamps", "topics_over_time_full", "flow_status", "chunk_windows", "mean_pool", "ner_tokens", "core_distances", "hdbscan_eom_planted",
    "kmeans_planted", "csv_corpus", "embeddings_roundtrip", "embed_cached", "embed_chunked", "classify_texts", "fit_planted", "fit_pos", "stability", "quality_of_fit", "v_quality", "v_flow_nodes", "stream_topic_counts",
]


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, name):
    assert compare(spark, con, catalogue.QUERIES[name], catalogue.SQL[name], SMALL) == ""


def test_every_sql_has_a_query():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
