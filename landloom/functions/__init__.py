"""Column functions; all are expressions that Catalyst sees through."""
