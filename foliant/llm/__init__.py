"""Operators for training text and for names typed by people. Nothing outside this folder imports it."""
