"""Tables written between the passes of an operator, in the folder that all executors share."""

from __future__ import annotations

from ..storage import shared_folder, written

__all__ = ["shared_folder", "written"]
