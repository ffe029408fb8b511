"""Table and file sources, and the sinks that load them."""
