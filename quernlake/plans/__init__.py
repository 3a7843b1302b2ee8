"""Driver-side planning: paths, predicates, regular expressions, configuration."""
