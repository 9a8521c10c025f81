"""Whole jobs: publishing run folders, prompt tables, and the registered queries."""
