"""Connected components, as the rest of the library has them."""

from ..operators.identity import components

__all__ = ["components"]
