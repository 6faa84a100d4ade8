"""All registered queries."""

from . import catalog_coordination, catalog_core  # noqa: F401
from .registry import QUERIES  # noqa: F401
