"""Runnable jobs over the library's operators; see each module's command line."""
