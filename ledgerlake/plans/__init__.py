"""Reports, the version catalog and the registered queries."""
