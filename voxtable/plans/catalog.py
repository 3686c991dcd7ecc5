"""All registered queries."""
from . import speech, retakes, sound, cleaning, editing, delivery  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
