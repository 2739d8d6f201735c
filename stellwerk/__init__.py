"""Stellwerk: timetable, delay and transfer analytics on Spark DataFrames."""
