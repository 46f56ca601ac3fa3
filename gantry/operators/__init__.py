"""Stages of the tolling pipeline, each a function from DataFrame to DataFrame."""
