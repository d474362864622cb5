"""Arrow-batched row functions, those of the core."""

from ..arrow import map_columns

__all__ = ["map_columns"]
