"""Column expressions: pixel algebra, scalar rules, the equal-area projection and named reducers."""
