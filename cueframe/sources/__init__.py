"""Readers and writers of subtitle files: rows of (key, content) in, rows of cues out, and back."""
