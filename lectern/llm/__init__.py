"""Operators of a training-data pipeline: ten methods over documents, pages, vectors and chats."""
