"""Import all query modules so that the registry is complete."""

from . import answering, results, tagging, text, vectors  # noqa: F401
from .registry import REGISTRY  # noqa: F401
