"""Readers of assistants' session files: each scans sessions and parses them into messages."""
