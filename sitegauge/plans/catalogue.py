"""All registered queries; importing the modules registers them."""

from . import company_queries, flow_queries, study_queries, text_queries, vector_queries  # noqa: F401
from .registry import CATALOGUE

__all__ = ["CATALOGUE"]
