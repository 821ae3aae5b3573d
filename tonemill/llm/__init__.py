"""Training-data operators: one module an operator, and their registered queries."""
