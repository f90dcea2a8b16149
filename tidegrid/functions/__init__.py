"""Functions from columns to columns; they stay inside generated code."""
