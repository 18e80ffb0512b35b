"""Import every plan module so the registry is complete."""

from driftline.plans import q_clean, q_drift, q_eval, q_gates, q_health, q_io, q_ml, q_monitor, q_order, q_outcomes, q_profile, q_slo, q_stream  # noqa: F401
from driftline.plans.registry import ORACLES, QUERIES  # noqa: F401
