"""Registered query plans: one Spark callable and (where SQL can express it) one
"""
