"""Random forests for the tests of trees."""


def grown(draw, n, spread):
    """Parents of nodes 0 to n - 1: mostly older nodes, with chains and hubs; -1 at roots."""
    parent = {0: -1}
    for i in range(1, n):
        kind = draw.random()
        parent[i] = -1 if kind < 0.03 else i - 1 if kind < 0.5 else draw.randrange(max(0, i - spread), i)
    names = draw.sample(range(10 * n), n)  # parents need not be older
    return {names[i]: names[p] if p >= 0 else None for i, p in parent.items()}
