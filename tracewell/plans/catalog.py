"""All registered queries; importing a section registers its entries."""

from tracewell.plans import sections  # noqa: F401
from tracewell.plans.registry import ORACLES, PLANS  # noqa: F401
