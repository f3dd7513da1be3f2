"""Readers and writers; every reader declares its schema."""
