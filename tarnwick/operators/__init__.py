"""Retrieval, graph, routing and mail operators over DataFrames."""
