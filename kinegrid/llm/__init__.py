"""Training-data operators: one module for each, `queries` for the registered queries."""
