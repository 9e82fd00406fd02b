"""Table operators, each a function from DataFrame(s) to a DataFrame.

columns, missing, profile, joins, ranking, distribution, agreement, sampling, metrics,
attribution (tables over contributions), model (spark.ml), trees (fitted tree structure),
treeshap (distributed tree attribution), thematic.
"""
