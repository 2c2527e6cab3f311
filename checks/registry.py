"""Imports every query module, so that they register."""

from checks import flagship, history, metrics, prompts, sampling, tokens  # noqa: F401
from checks.base import ORACLES, QUERIES  # noqa: F401
