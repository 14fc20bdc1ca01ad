"""Cohort and time-to-event analysis on Spark DataFrames.

Every public function takes DataFrames (plus plain parameters) and returns a
lazy DataFrame.  There is no global state: sessions, paths, code lists and study
dates are arguments.
"""
