"""Plan shapes shared by the operators: skew-safe joins and two-level prefix sums."""
