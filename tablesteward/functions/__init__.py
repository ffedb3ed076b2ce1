"""Column expressions; none of them needs a shuffle."""
