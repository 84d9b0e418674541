"""Tables written between jobs, in the folder that all executors share: later jobs neither recompute them nor depend on any executor's local files."""

from kindred.sources.scratch import stored as keep

__all__ = ["keep"]
