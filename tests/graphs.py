"""A plain union-find, to test distributed components against."""


def components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {x: find(x) for x in list(parent)}


def shapes():
    """Edges of graphs that need few, many, or uneven steps."""
    import random

    r = random.Random(3)
    yield "none", []
    yield "loops and nulls", [(1, 1), (None, 2), (3, None)]
    yield "chain in order", [(i, i + 1) for i in range(60)]
    mixed = r.sample(range(60), 60)
    yield "chain out of order", list(zip(mixed, mixed[1:]))
    yield "star around the largest", [(100, i) for i in range(40)] + [(i, 100) for i in range(10)]
    yield "cycle and pair", [(i, (i + 1) % 7) for i in range(7)] + [(50, 51), (51, 50), (50, 51)]
    yield "random", [(r.randrange(120), r.randrange(120)) for _ in range(90)]
