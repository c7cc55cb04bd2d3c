"""Column expressions: keys, calendar attributes, typed coercion."""
