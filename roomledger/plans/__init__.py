"""Named queries over the given tables, each next to its SQL counterpart."""
