"""Training-data operators: one module per operator, registered in ``llm.registry``."""
