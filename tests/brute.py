"""Plain Python answers to compare with."""


def distance(a: int, b: int) -> int:
    return ((a ^ b) & (2**64 - 1)).bit_count()


def pairs(rows: dict[int, int], k: int) -> set[tuple[int, int, int]]:
    """All pairs ``a < b`` of ids within ``k`` bits."""
    items = sorted(rows.items())
    found = set()
    for i, (a, x) in enumerate(items):
        for b, y in items[i + 1 :]:
            if distance(x, y) <= k:
                found.add((a, b, distance(x, y)))
    return found


def labels(nodes, links) -> dict[int, int]:
    """Smallest reachable node for every node."""
    near = {n: set() for n in nodes}
    for a, b, *_ in links:
        near[a].add(b)
        near[b].add(a)
    label = {}
    for start in sorted(nodes):
        if start in label:
            continue
        todo = [start]
        while todo:
            node = todo.pop()
            if node not in label:
                label[node] = start
                todo.extend(near[node])
    return label


def groups(rows: dict[int, int], k: int) -> dict[int, int]:
    return labels(rows, pairs(rows, k))
