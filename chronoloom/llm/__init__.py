"""Operators for training data. Nothing outside this folder and its tests imports it."""
