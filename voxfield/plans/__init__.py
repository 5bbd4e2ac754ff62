"""All registered queries."""

from . import dataset_queries, field_queries, file_queries, spec_queries, survey_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
