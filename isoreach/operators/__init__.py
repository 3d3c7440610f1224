"""The steps of the five methods, each a DataFrame to DataFrame function usable alone."""

from .access import (
    complete_scores,
    merge_scores,
    spai_2sfca,
    spai_3sfca,
    spai_e2sfca,
    spai_e3sfca,
    spai_m2sfca,
)
from .catchment import dedupe_od, within_catchment
from .checks import null_keys, repeated_keys, validate_facilities, validate_od, validate_origins
from .choice import huff_probability, selection_weights
from .lookup import lookup_join
from .ratios import rij_m2sfca, rj_2sfca, rj_3sfca, rj_e2sfca, rj_e3sfca
from .stored import StoredPairs, open_by_origin, store_by_origin, store_pairs

__all__ = [
    "StoredPairs",
    "complete_scores",
    "dedupe_od",
    "huff_probability",
    "lookup_join",
    "merge_scores",
    "null_keys",
    "open_by_origin",
    "repeated_keys",
    "rij_m2sfca",
    "rj_2sfca",
    "rj_3sfca",
    "rj_e2sfca",
    "rj_e3sfca",
    "selection_weights",
    "spai_2sfca",
    "spai_3sfca",
    "spai_e2sfca",
    "spai_e3sfca",
    "spai_m2sfca",
    "store_by_origin",
    "store_pairs",
    "validate_facilities",
    "validate_od",
    "validate_origins",
    "within_catchment",
]
