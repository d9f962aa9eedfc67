"""Sources and sinks: see files."""
