"""Sources and sinks: raw-table fixtures, declared schemas, table and model IO."""
