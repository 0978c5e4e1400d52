"""Plans of several operators: expressions, search, walk-forward."""
