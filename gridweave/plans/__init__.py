"""Driver loops over operators: hierarchies, cycles and solvers."""
