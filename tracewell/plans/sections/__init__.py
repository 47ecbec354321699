"""One module per operator family."""

from tracewell.plans.sections import aggregates, anomaly, audits, decisions, events, joins, learning, metrics, scalars, splits, windows  # noqa: F401
