"""Imports every query module so that the registry is complete."""

from . import (chains, grids, landing, matching, modelling, panels, payload_queries, sensors,  # noqa: F401
               series)
from .base import ORACLES, REGISTRY  # noqa: F401
