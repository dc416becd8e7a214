"""Training-data operators: one module each, plus the kernels they share."""
