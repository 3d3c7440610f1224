"""Column builders: everything stays a built-in Spark expression."""

from .decay import binary_weight, gaussian_weight, linear_weight, weight
from .ids import id_text, last_word
from .numeric import finite_or_zero, nan_safe_sum, number, positive_ratio, safe_ratio

__all__ = [
    "binary_weight",
    "finite_or_zero",
    "gaussian_weight",
    "id_text",
    "last_word",
    "linear_weight",
    "nan_safe_sum",
    "number",
    "positive_ratio",
    "safe_ratio",
    "weight",
]
