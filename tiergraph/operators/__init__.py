"""DataFrame -> DataFrame operators over the graph, signal, call and price tables."""
