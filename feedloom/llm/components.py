"""Connected components of an edge table: those of the library."""

from __future__ import annotations

from ..operators.components import resolve as components

__all__ = ["components"]
