"""Connected components; they serve other near-duplicate operators, too."""

from tidemark.operators.components import connected_components

__all__ = ["connected_components"]
