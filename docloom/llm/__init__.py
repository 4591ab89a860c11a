"""Training-data operators: one module each, plus ``registry`` with their queries."""
