"""Readers from files and texts to addressable regions."""
