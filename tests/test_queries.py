"""Named queries against their check SQL. GENOLOOM_ALL=1 runs every one of them."""
import os
import re

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from genoloom.plans import all_queries

SF_DIR = "/root/testdata/sf0.01"
NAMES = list(all_queries())
# One or two of each family; the full list takes about five minutes.
DEFAULT = """
s3_after_banner s4_dense_matrix s5_dense_transposed s6_matrix_market s7_multi_file s9_many_aggregates s14_dataset_build s16_tissue_clusters
n2_count_info n4_quality_cells n4_quality_report n10_mode_per_dataset n12_label_rules n12_rules_per_dataset n18_keep_first n20_union_batches n21_near_duplicates
c2_dense_blocks c3_spearman c4_bicor c8_pair_spine c9_rsr c9_rsr_ranks c9_rsr_many_datasets c9_rsr_spearman c11_all_datasets_cor c15_avg_coexpr_head_tail
m3_comeasured m3_undefined_types m6_measurement_classes m9_rank_sum_tf r3_allrank r4_impute_median r7_consensus_ranks r8_ortholog_ranks
k1_tie_adjusted_k k9_colwise_auc k12_shuffled_spearman k15_similarity_all_tfs k16_null_similarity k18_query_cor k20_query_topk_all k21_query_cor_all
y1_similarity_summary y4_divergent y7_cross_species_top u3_single_step u4_all_steps u5_saturation u9_recovery_step u10_exponential_fit
x2_overlap_table x3_overlap_quantiles x5_null_spearman x10_generic_hubs l6_append_and_exclude l10_curated_labels l11_target_universe
a1_performance_curves a3_auprc a4_null_performance a6_recovery_table a8_average_against_single a14_ortholog_share a16_generic_check_wide a20_test_integrated
i1_join_binding i2_ortholog_evidence i9_flat_tiers i10_tally i13_recurrence_summary i18_other_species_ranks
g1_enrichment g7_terms_across_species g12_match_tables t1_rank_sum t4_large_group_summary t7_histogram v6_set_operations q1_invariants
""".split()
RUN = NAMES if os.environ.get("GENOLOOM_ALL") else DEFAULT
# How many numbered operators each family of the inventory has.
FAMILIES = {"s": 16, "n": 23, "c": 16, "m": 13, "r": 12, "k": 21, "y": 9, "u": 11, "x": 12, "l": 11, "a": 21, "i": 21, "g": 14, "t": 8, "v": 14, "q": 1}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", RUN)
def test_query_equals_sql(spark, con, name):
    rows, error = compare(spark, con, SF_DIR, name, entry.queries()[name], entry.oracle_sql()[name])
    assert error is None


def test_every_inventory_id_has_a_query():
    have = {re.match(r"([a-z]+\d+)_", n).group(1) for n in NAMES}
    want = {f"{family}{i}" for family, n in FAMILIES.items() for i in range(1, n + 1)}
    assert want <= have


def test_every_query_has_check_sql():
    assert set(NAMES) <= set(entry.oracle_sql())


def test_entry_returns_ranked_pairs(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 50 and all(0 < r["rsr"] <= 1 for r in rows)


def test_small_scale_runs(spark):
    for name in ("c9_rsr", "r7_consensus_ranks", "a2_auroc", "i9_flat_tiers", "l8_targets_per_tf"):
        entry.queries()[name](spark, "/root/testdata/sf0.001").collect()
