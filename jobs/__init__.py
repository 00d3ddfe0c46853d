"""Runnable jobs over the library; each is a module with a command line, and a function that takes a session."""
