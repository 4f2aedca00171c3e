"""Column functions on spans, attribute lists, texts and JSON payloads."""
