"""Driver-loop plans: iteration runtime, PageRank, connected components."""
