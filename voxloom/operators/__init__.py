"""DataFrame operators: cleaning, scoring, clustering, profiling, requirements."""
