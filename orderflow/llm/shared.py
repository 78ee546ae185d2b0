"""Where intermediate tables go, and how lineage is cut: as for the rest of the library."""

from ..sources.shared import cut, scratch, shared_dir, shuffle_partitions

__all__ = ["cut", "scratch", "shared_dir", "shuffle_partitions"]
