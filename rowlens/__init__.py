"""rowlens: semantic table comparison on Spark."""

from .api import diff, diff_files, diff_frames, plan
from .plans.config import DiffError, Options

__all__ = ["DiffError", "Options", "diff", "diff_files", "diff_frames", "plan"]
