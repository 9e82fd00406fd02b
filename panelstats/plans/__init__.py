"""Registered queries over the driver's tables, and the DuckDB SQL that checks them.

``fixtures`` maps the driver's TPC-H-like tables onto the panel roles (assessments,
classes, events as ordered assessments, fixed predictions); ``catalog`` holds one Spark
query per operator key; ``oracle`` the equivalent SQL for every key that SQL can express.
"""
