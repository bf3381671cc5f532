"""Table-backed sources and sinks."""
