"""Whole tasks put together from operators."""
