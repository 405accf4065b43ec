"""Per-group operators over streams."""
