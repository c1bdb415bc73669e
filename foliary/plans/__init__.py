"""Derived test views, the registered queries and their check SQL."""
