"""Sources, sinks and the catalog of panels."""
