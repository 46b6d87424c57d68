"""Training-data operators: one module per operator, one query module each through ``queries``."""
