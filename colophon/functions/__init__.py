"""Column functions: text, string sets, title keys, blacklists."""
