"""Where graphs come from and where snapshots are kept."""
