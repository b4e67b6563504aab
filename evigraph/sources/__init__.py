"""Document parsers, file sources and snapshots."""
