"""Whole runs: the fused plan, the step by step plan, and the job from files to CSV."""

from .fused import accessibility
from .job import run
from .stepwise import accessibility_by_steps

__all__ = ["accessibility", "accessibility_by_steps", "run"]
