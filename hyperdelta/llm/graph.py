"""Connected components over an edge table: the library's own."""

from ..graph import components

__all__ = ["components"]
