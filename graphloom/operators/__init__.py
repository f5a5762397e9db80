"""Graph operators: edges are ``u, v`` with u < v, adjacency is ``s, d`` in both directions."""
