"""Plan shapes several operators share: lookups, ranks, running sums, quantiles."""
