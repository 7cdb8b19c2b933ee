"""Physical plans: nothing multiplies rows without a key, scans read what they need."""
import contextlib
import io

import pytest

import __spark_entry__ as entry
from genoloom.operators import correlate
from genoloom.plans.fixtures import Tables
from genoloom.plans.q_sources import agg_parts
from genoloom.sources.readers import read_aggregates

SMALL = "/root/testdata/sf0.01"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_no_query_joins_without_a_key(spark):
    bad = {}
    for name, fn in entry.queries().items():
        text = plan(fn(spark, SMALL))
        hits = [x for x in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython") if x in text]
        if hits:
            bad[name] = hits
    assert bad == {}


def test_column_pruning_reaches_the_scan(spark):
    text = plan(Tables(spark, SMALL).expr_a)
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_quantity:double>" in text


def test_dataset_and_gene_filters_reach_the_scan(spark):
    text = plan(read_aggregates(spark, agg_parts(Tables(spark, SMALL)), [3], [5, 10]))
    assert "PartitionFilters: [isnotnull(dataset_id" in text or "PartitionFilters: [dataset_id" in text
    assert "PushedFilters: [In(gene_b, [" in text


def test_top_sets_keep_k_rows_before_the_shuffle(spark):
    t = Tables(spark, SMALL)
    text = plan(entry.queries()["k6_colwise_topk"](spark, SMALL))
    assert "WindowGroupLimit" in text
    assert t.genes_b.n == 50


def test_correlation_joins_nothing_but_sizes(spark):
    t = Tables(spark, SMALL)
    text = plan(correlate.pair_correlation(t.expr_f, t.meta_f, t.genes_f))
    assert text.count("FlatMapGroupsInPandas") >= 2
    assert "SortMergeJoin" not in text.split("Initial Plan")[0] or "n_cells" in text


@pytest.mark.parametrize("name", ["c9_rsr", "r7_consensus_ranks", "k15_similarity_all_tfs"])
def test_plans_are_deterministic(spark, name):
    fn = entry.queries()[name]
    a = sorted(map(tuple, fn(spark, SMALL).collect()), key=repr)
    b = sorted(map(tuple, fn(spark, SMALL).collect()), key=repr)
    assert a == b
