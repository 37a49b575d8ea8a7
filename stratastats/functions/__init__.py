"""Column expressions. Everything here stays inside whole-stage codegen."""

from .buckets import bucket_index, bucket_label, decode, label_order, near_zero_flag, sign_flag
from .ids import (
    cast_string,
    concat_ids,
    first_token,
    format_label,
    id_prefix,
    map_or_self,
    parse_dates,
    region_label,
    scientific_label,
    zero_pad,
)
from .numeric import (
    minmax,
    nan_as_null,
    rate_per_weight,
    ratio,
    round_significant,
    round_trunc_int,
    scale_units,
)
from .predicates import contains_any, in_list, not_equal, not_in, within_year
from .weighted import Terms, amount_terms, weighted_avg, weighted_terms

__all__ = [
    "Terms",
    "amount_terms",
    "bucket_index",
    "bucket_label",
    "cast_string",
    "concat_ids",
    "contains_any",
    "decode",
    "first_token",
    "format_label",
    "id_prefix",
    "in_list",
    "label_order",
    "map_or_self",
    "minmax",
    "nan_as_null",
    "near_zero_flag",
    "not_equal",
    "not_in",
    "parse_dates",
    "rate_per_weight",
    "ratio",
    "region_label",
    "round_significant",
    "round_trunc_int",
    "scale_units",
    "scientific_label",
    "sign_flag",
    "weighted_avg",
    "weighted_terms",
    "within_year",
    "zero_pad",
]
