"""All registered queries."""

from estatespark.verification import fitted, models, photos, tabular  # noqa: F401
from estatespark.verification.registry import CHECKS

__all__ = ["CHECKS"]
