"""Plans as SQL over named tables."""
