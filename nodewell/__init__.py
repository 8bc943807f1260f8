"""Batch and streaming jobs for the data of edge device fleets, as functions from DataFrame to DataFrame."""
