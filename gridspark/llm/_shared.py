"""The shared folder that outlives an executor: checkpoints and working tables."""

from __future__ import annotations

from gridspark.session import new_path, saved, shared_dir

__all__ = ["new_path", "saved", "shared_dir"]
