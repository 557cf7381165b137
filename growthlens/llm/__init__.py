"""Training-data operators: one module per operator, their registered queries in ``catalog``."""
