"""Rule tables, text expressions and scaling helpers."""
