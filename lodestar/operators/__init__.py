"""Search, quantisation, graph, page layout and experiment operators."""
