"""Binds the operators to the handle as methods; importing this module is enough."""

from __future__ import annotations

from axisweave.matrix import Matrix
from axisweave.operators import arith, cluster, factor, labels, product, similar, stats, topk
from axisweave.sources import build, export

METHODS = {
    labels: "restrict exclude get sample_values without_zeros diagonal without_diagonal without_mask nonzero_mask zeros truncate_with_cutoff transpose renumber sort tril triu take slice_positions rename set_deco align extend symmetrize sample_labels element_sample random_label is_one_hot check_positive",
    arith: "combine add subtract multiply divide maximum minimum scale add_vector map_cells apply sign power sqrt inverse log log1p exp trunc clip logistic compatibility",
    product: "dot mask_dot shadow pairwise_top dot_vector dot_vector_dot shadow_vector_dot kron row_kron row_kron_dot row_kron_dot_transpose row_kron_second_moment second_moment pairwise_l2square linear_error",
    stats: "mean variance deviation sum_power count_nonzero norm normalize arg_extreme dict_max dict_argmax group_rows divergence cosine_gram coherence gram_quantiles row_mean_gini volume_at_cutoff anomaly default_row",
    topk: "rank truncate truncate_by_count truncate_by_cumulative truncate_by_budget truncate_by_groups quantile median quantile_boundaries quantile_bins reco reco_summary",
    similar: "similarity jaccard top_values_similarity round_robin_allocation argmax_allocation",
    cluster: "connected_components hierarchical_clustering sort_by_clustering tail_clustering affinity_clusters spectral_clusters co_clustering",
    factor: "randomized_svd svd svd_approximation rank_from_variance_ratio nmf nmf_fold nmf_approximation nmf_rank",
    export: "to_flat to_wide to_lists to_rows to_dense to_arrow to_numpy write write_bucketed",
}

for module, names in METHODS.items():
    for name in names.split():
        setattr(Matrix, name, getattr(module, name))
Matrix.sum, Matrix.max, Matrix.min = stats.total, stats.maximum_of, stats.minimum_of
Matrix.abs, Matrix.round = arith.absolute, arith.rounded

from_cells, from_pivot, from_occurrence, from_dict, from_lists, from_dense, from_diagonal, from_random = (
    getattr(build, f"from_{x}") for x in "cells pivot occurrence dict lists dense diagonal random".split()
)
hstack, vstack, reduce_sum, reduce_product, read = labels.hstack, labels.vstack, arith.reduce_sum, arith.reduce_product, export.read
