"""flowlens package."""
