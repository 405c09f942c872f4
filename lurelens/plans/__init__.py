"""Registered queries: each topic module pairs a DataFrame plan with its SQL twin."""
