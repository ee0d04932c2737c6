"""Registered queries: name -> (plan, SQL for comparison or None)."""
