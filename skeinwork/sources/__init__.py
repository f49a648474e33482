"""Readers of files, and what turns them into documents."""
