"""Readers, writers and catalog lookups."""
