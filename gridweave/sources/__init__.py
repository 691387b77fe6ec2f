"""Where graphs and matrices come from."""
