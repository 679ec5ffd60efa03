"""Part of siltlog."""
