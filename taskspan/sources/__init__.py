"""Readers, writers, stored stages and the input mapping."""
