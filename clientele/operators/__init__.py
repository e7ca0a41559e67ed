"""Dataset operators, one module per family."""
