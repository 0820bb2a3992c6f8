"""DataFrame operators: pair preparation, model inference and evaluation."""
