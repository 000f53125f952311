"""tabulon: cleaning, profiling, statistics and tree-ensemble modelling of
customer and survey tables, written as Spark DataFrame, ML and Streaming work.
"""
