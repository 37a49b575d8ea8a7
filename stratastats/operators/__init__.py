"""DataFrame operators."""

from .aggregates import carried, carry_first, group_sum
from .correlation import pivot_matrix, spearman
from .distribution import (
    excess_kurtosis,
    histogram,
    histogram_panel,
    normal_curve,
    normal_fit,
    normality_report,
)
from .exactsum import exact_sums, weighted_means
from .extremes import bottom_n, extremes, extremes_panel, measure_extremes, top_n
from .hierarchy import category_dictionary, major_class, roll_up
from .keys import key_report, total_rows
from .maptable import map_table, map_tables, metric_metadata, minmax_normalise
from .merge import inner_join, merge_coverage, merge_sources
from .profile import describe_numeric, distinct_values, head_n, null_profile, sample_n, schema_profile
from .quantiles import grouped_median, grouped_percentiles
from .rank import average_rank
from .reshape import flatten_map, union_all, unpivot_drop_null
from .strata import (
    composition,
    drift_domain,
    nominal_drift,
    select_strata,
    sort_custom_order,
    with_drift_flags,
)

__all__ = [
    "average_rank",
    "bottom_n",
    "carried",
    "carry_first",
    "category_dictionary",
    "composition",
    "describe_numeric",
    "distinct_values",
    "drift_domain",
    "exact_sums",
    "excess_kurtosis",
    "extremes",
    "extremes_panel",
    "flatten_map",
    "group_sum",
    "grouped_median",
    "grouped_percentiles",
    "head_n",
    "histogram",
    "histogram_panel",
    "inner_join",
    "major_class",
    "key_report",
    "map_table",
    "map_tables",
    "measure_extremes",
    "merge_coverage",
    "merge_sources",
    "metric_metadata",
    "minmax_normalise",
    "nominal_drift",
    "normal_curve",
    "normal_fit",
    "normality_report",
    "null_profile",
    "pivot_matrix",
    "roll_up",
    "sample_n",
    "schema_profile",
    "select_strata",
    "sort_custom_order",
    "spearman",
    "top_n",
    "total_rows",
    "union_all",
    "weighted_means",
    "unpivot_drop_null",
    "with_drift_flags",
]
