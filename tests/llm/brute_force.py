"""Brute-force versions that several tests compare with."""

from collections import Counter, defaultdict

from pactscope.llm.suffix_dedup import merged

L = 200


def weighted(text):
    lowered = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = "".join(chr(c) if c >= 128 or chr(c).isalnum() else " " for c in lowered).split(" ")
    words = [w for w in words if w]
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()


def brute(a, b):
    every = set(a) | set(b)
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in every) for i in a if i in b)


def classes(rows):
    """Smallest id of the class of each row, by comparing all pairs that share a shingle."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets, holders, same = [weighted(t) for _, t in rows], defaultdict(list), {}
    for i, (_, text) in enumerate(rows):
        parent[find(i)] = find(same.setdefault(text or "", i))
        for shingle in sets[i]:
            holders[shingle].append(i)
    for pair in {(a, b) for held in holders.values() for k, a in enumerate(held) for b in held[:k]}:
        if find(pair[0]) != find(pair[1]) and brute(sets[pair[0]], sets[pair[1]]) >= 0.8:
            parent[find(pair[0])] = find(pair[1])
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return {doc_id: least[find(i)] for i, (doc_id, _) in enumerate(rows)}


def repeated_runs(texts):
    """Runs of bytes that strings cover which start elsewhere too, for each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + L] for t in data for i in range(len(t) - L + 1))
    return [merged([{"start": i, "stop": i + L} for i in range(len(t) - L + 1) if seen[t[i : i + L]] > 1]) for t in data]
