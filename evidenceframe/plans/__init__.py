"""Query plans made of operators."""
