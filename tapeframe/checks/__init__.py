from . import factor_checks, fold_checks, operator_checks, quality_checks, screening_checks, sequence_checks  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
