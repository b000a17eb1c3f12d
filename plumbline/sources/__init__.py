"""Datasets: a registry of formats, each read into items and targets."""
