"""Readers, writers and the test binding."""
