"""Column expressions shared by the operators."""

from taxograph.functions.columns import blank_to_null, kind_letter, saturated_depth

__all__ = ["blank_to_null", "kind_letter", "saturated_depth"]
