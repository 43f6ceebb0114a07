"""Multi-step plans composed of operators."""
