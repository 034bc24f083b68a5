"""Readers and writers of annotations, submissions and reports."""
