"""Operators on link tables; each module is one family."""
