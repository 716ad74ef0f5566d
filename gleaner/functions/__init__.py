"""Scalar building blocks: Column expressions and pure functions on str."""
