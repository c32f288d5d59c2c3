"""Part of axisweave."""
