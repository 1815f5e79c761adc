"""Operators for preparing training data: each works on whole tables and stands apart from the rest of the library."""
