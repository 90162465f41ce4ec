"""Compositions: exports to a bundle, a bundle to files and reports."""
