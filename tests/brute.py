"""Plain-Python oracles, written from the published definitions, for small fixtures."""


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], (prev + 1 if x == y else max(row[j], row[j - 1]))
    return row[-1]


def ratio(a, b):
    a, b = (" ".join(sorted(s.lower().split())) for s in (a or "", b or ""))
    total = len(a) + len(b)
    return 100.0 if not total else (1 - (total - 2 * lcs(a, b)) / total) * 100


def greedy(pred, truth, threshold=70):
    free, out = set(range(len(truth))), []
    for name in pred:
        ranked = sorted(free, key=lambda j: (-ratio(name, truth[j]), j))
        hit = ranked[0] if ranked and ratio(name, truth[ranked[0]]) >= threshold else -1
        free.discard(hit)
        out.append(hit)
    return out


def best(pred, truth):
    return [
        min(((-ratio(name, t), j) for j, t in enumerate(truth)), default=(1.0, -1))
        for name in pred
    ]
