"""Column expressions: recodes, labels, ranks and quantiles, distribution tails."""
