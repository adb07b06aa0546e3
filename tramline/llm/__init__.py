"""Operators for training data: top N per group, tokenizing, mixing sources, spam pages."""
