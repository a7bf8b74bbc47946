"""The built-in named predicates, by field of use."""

from . import amounts, aviation, codes, contact, dates, financial, health, numbers, reference, shapes, tax
from .base import BUILT_IN

__all__ = ["BUILT_IN", "amounts", "aviation", "codes", "contact", "dates", "financial", "health", "numbers", "reference", "shapes", "tax"]
