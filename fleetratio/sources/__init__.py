from .checkpoints import checkpoint_dir, cut_lineage, shared_folder
from .tables import read_fleet, read_observer, read_table, write_partitioned, write_result

__all__ = [
    "checkpoint_dir", "cut_lineage", "read_fleet", "read_observer", "read_table", "shared_folder", "write_partitioned", "write_result",
]
