"""Relational operators over decision rows: frames in, frames out."""
