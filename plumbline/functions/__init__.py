from plumbline.functions.scalars import (
    bin_label,
    clamp_non_negative,
    epoch_ms,
    fixed_text,
    frequency_key,
    in_domain,
    integer_prefix,
    is_date,
    is_icd10,
    is_missing,
    is_postcode,
    iso_text,
    loose_number,
    month_of,
    parse_date,
    percent,
    percent_text,
    round_half_up,
    strict_number,
    weekday,
    whole_number,
    year_of,
)

__all__ = [
    "bin_label",
    "clamp_non_negative",
    "epoch_ms",
    "fixed_text",
    "frequency_key",
    "in_domain",
    "integer_prefix",
    "is_date",
    "is_icd10",
    "is_missing",
    "is_postcode",
    "iso_text",
    "loose_number",
    "month_of",
    "parse_date",
    "percent",
    "percent_text",
    "round_half_up",
    "strict_number",
    "weekday",
    "whole_number",
    "year_of",
]
