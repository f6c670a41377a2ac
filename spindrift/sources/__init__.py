"""Sources and sinks: files, event logs, snapshots and caches."""
