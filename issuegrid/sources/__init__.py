"""Sources and sinks: base-table scans, file listing, writers, stand-in tables."""
