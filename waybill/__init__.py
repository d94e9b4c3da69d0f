"""Waybill: plan, check and prove bulk data migrations as Spark jobs.

Every public operator takes DataFrames (plus a little configuration) and returns a DataFrame.
"""
