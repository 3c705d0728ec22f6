"""Operators for preparing training text on Spark.

Nothing outside this subpackage imports it.  Each operator module has a general
DataFrame interface; ``queries`` registers one thin query per operator.
"""
