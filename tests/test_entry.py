"""The driver contract."""

import __spark_entry__ as entry
from plantscope import plans

# queries without SQL: random, hashed, tree-based or iterative results
ROWS_ONLY = {
    "source_fingerprint", "source_scan_files", "source_file_checksums",
    "distribution_weibull", "distribution_gamma", "distribution_ranked_fits",
    "distribution_ks_all_families", "distribution_ks_counts",
    "model_random_split", "model_linear_holdout", "model_quadratic_holdout", "model_factorial_coefficients",
    "model_forest_holdout", "model_boosted_holdout", "model_hybrid_holdout", "model_logistic_report",
    "model_weibull_life", "model_selected_features", "validation_folds", "validation_forest_folds",
    "validation_leave_one_out", "anova_significance", "anova_coefficient_intervals", "anova_factorial_rows",
    "anova_pareto_terms", "anova_fit_level", "interaction_strength_trees", "sensitivity_permutation",
    "contribution_factors", "governance_model_comparison", "governance_prediction_interval",
    "governance_next_experiments", "governance_forest_spread",
    "governance_response_grid_trees", "governance_best_setting_forest",
    "forecast_dynamic_regression", "forecast_forest", "forecast_boosted", "forecast_residual_hybrid",
    "forecast_residual_hybrid_mean", "forecast_recursive_forest", "forecast_fitted_fold_metrics", "forecast_fitted_gate",
    "quality_readiness_best_family", "distribution_density_curve_all",
    "forecast_recursive", "forecast_importance", "forecast_block_permutation", "forecast_conditional_contrasts",
    "risk_bootstrap_rows", "deidentify_noise", "deidentify_fingerprint",
}


def test_every_other_query_has_sql():
    own = set(plans.all_queries())
    assert own - set(entry.oracle_sql()) == ROWS_ONLY
    assert own <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5 and {r.event_type for r in rows} == {"click", "view", "signup", "error", "purchase"}
