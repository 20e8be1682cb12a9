"""Readers and writers: raw log lines, stored events, JSON documents."""
