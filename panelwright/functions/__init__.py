"""Part of the panel research library."""
