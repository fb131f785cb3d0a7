"""Column functions: they add no stage and no shuffle to a plan."""
