"""Runnable queries by operator name."""

from noonday.plans import (  # noqa: F401
    q_binary, q_catalogue, q_clean, q_match, q_periods, q_report, q_rollup, q_series, q_sleep, q_stream, q_text,
)
from noonday.plans.registry import REGISTRY  # noqa: F401
