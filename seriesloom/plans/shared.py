"""A folder that the driver and all executors can reach."""

from ..sources.scratch import shared_path

__all__ = ["shared_path"]
