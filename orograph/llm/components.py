"""Connected components, as the rest of the library has them."""

from __future__ import annotations

from orograph.operators.components import components  # noqa: F401
