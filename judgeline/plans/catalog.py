"""All registered queries."""

from judgeline.plans import (  # noqa: F401
    q_agreement,
    q_files,
    q_fusion,
    q_metrics,
    q_retrieval,
    q_tables,
    q_text,
    q_training,
)
from judgeline.plans.registry import QUERIES, oracle

__all__ = ["QUERIES", "oracle"]
