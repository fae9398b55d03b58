"""Registered queries: name -> (Spark callable, SQL for the check or None)."""
