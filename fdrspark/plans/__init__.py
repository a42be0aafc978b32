"""Solvers and how they are spread over a cluster."""
