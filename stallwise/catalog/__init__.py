"""All registered queries."""

from .registry import ENTRIES
from . import basic, cleaning, deep, panels, recommending, serving
from . import proofs, report  # isort: skip

__all__ = ["ENTRIES"]
