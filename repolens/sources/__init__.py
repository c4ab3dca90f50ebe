"""Sources and sinks: source trees, git logs, configuration, parquet stores."""
