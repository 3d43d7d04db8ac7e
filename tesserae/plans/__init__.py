"""Registered queries: name -> f(spark, sf_dir), and the SQL of those that have one."""

from . import boolean_queries, compare_queries, gene_queries, graph_queries, io_queries, matrix_queries, more_queries, symbolic_queries, vector_queries

QUERIES, SQL = {}, {}
for _module in (matrix_queries, compare_queries, vector_queries, graph_queries, boolean_queries, gene_queries, more_queries, symbolic_queries, io_queries):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
