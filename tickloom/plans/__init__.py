"""Whole plans: the experiment run and its reports."""
