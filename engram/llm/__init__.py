"""Operators on text for training data: names, evaluation leaks, mixing, look-alikes. Optional."""
