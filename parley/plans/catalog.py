"""Imports every query module so the registry is complete."""

from . import q_text  # noqa: F401
from . import q_quality  # noqa: F401
from . import q_split  # noqa: F401
from . import q_metrics  # noqa: F401
from . import q_models  # noqa: F401
from . import q_fixed  # noqa: F401
from .registry import ORACLE, QUERIES, entry_query  # noqa: F401
