"""The engine that this one matches has no stream abstraction, so there is none here; metrics arrive as batch tables."""
