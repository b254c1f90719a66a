"""Column expressions: text, numbers, arrays, chat."""
