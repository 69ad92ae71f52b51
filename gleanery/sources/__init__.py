"""Sources and sinks: file trees, snapshots, evaluation suites, reports and packets."""
