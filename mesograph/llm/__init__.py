"""Operators that prepare the texts, files and records of annotated images for training a language model."""
