"""How a log is cut into independently foldable parts, and the plan that needs no fold."""
