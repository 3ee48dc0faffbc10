"""Composite jobs (public API): prepare, evaluate, compare, map_report, case_study."""
