"""Readers of raw log files and the tables the jobs exchange."""
