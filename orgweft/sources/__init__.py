"""Readers of offline work exports. Each gives one export row shape as a DataFrame."""
