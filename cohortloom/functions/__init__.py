"""Column expressions and the fixed code lists."""

from cohortloom.functions.columns import (
    age_years,
    days_between,
    flag_is_one,
    label_from_target,
    mortality_target,
    text_contains_any,
    text_matches,
)
from cohortloom.functions.fixed_values import ADMISSION_DIAGNOSES, RISK_MARKERS, TITLE_WORDS

__all__ = [
    "ADMISSION_DIAGNOSES",
    "RISK_MARKERS",
    "TITLE_WORDS",
    "age_years",
    "days_between",
    "flag_is_one",
    "label_from_target",
    "mortality_target",
    "text_contains_any",
    "text_matches",
]
