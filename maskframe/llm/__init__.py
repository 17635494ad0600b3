"""Text- and split-oriented operators for training corpora; nothing outside this package imports it."""
