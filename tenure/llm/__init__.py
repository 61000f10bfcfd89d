"""Training-corpus operators: one module per operator, their registered queries in ``queries``."""
