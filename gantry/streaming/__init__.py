"""The pipeline on unbounded input.

Four queries hand their results on through files: vehicles (entries and stops), statistics,
accidents, notifications. Each has its own checkpoint and watermark.
"""
