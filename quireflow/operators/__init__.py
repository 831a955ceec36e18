"""DataFrame operators: sections, lexicon matches, candidates, units, graphs, retrieval, reports, labels and metrics."""
