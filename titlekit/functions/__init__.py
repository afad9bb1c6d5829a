"""Column expressions; nothing in here shuffles."""
