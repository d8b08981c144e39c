"""When and how levels are merged."""
