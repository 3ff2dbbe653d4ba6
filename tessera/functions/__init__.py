"""Scalar building blocks: column expressions on texts and vectors."""
