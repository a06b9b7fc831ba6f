"""DataFrame operators: log folding, statistics, search, spatial joins, enrichment."""
