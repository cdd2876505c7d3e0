"""DataFrame-to-DataFrame operators: slices, candidates, panel, metrics and selection."""
