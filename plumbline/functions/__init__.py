"""Scalar and geometry functions."""
