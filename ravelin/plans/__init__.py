"""Named queries over the driver's tables and the SQL that each must agree with."""

from ravelin.plans import checks, composites, experiments, inference, measures, relational, reports, samples, sequences, texts  # noqa: F401
from ravelin.plans.registry import ORACLES, QUERIES  # noqa: F401
