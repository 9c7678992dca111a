"""Explainable discovery feeds as DataFrame-to-DataFrame functions."""
