"""Registered queries over the given tables. All modules are imported here, so that their queries register themselves."""

from laminar.plans import registry  # noqa: F401  first: the others register there
from laminar.plans import assembly, constraints, formats, further, quality, reports, stitching  # noqa: E402, F401
