"""Readers and writers of labelled text, features and results."""
