"""Training-data operators: ten corpus operators and the pipeline made of them."""
