"""Sources (CSV loader, driver-table adapters) and sinks."""
