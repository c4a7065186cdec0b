"""Sources, sinks and field configuration."""
