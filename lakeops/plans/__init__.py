"""Jobs that chain readers, operators and sinks."""
