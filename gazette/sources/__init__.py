"""Sources and sinks: driver tables, derived model tables, feeds, seed CSV,
job messages, text artifacts, and the writers of each."""
