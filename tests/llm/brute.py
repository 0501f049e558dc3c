"""Plain versions of the operators, for small tables."""


def shingle_sets(rows, k=5):
    """doc_id -> set of word shingles."""
    out = {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        out.setdefault(doc, set())
        if words:
            n = min(k, len(words))
            out[doc] |= {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}
    return out


def components(sets, percent=85):
    """doc_id -> smallest doc_id reachable over links."""
    label = {d: d for d in sets}
    docs = sorted(d for d in sets if sets[d])
    by_shingle = {}
    for d in docs:
        for s in sets[d]:
            by_shingle.setdefault(s, []).append(d)
    seen = set()

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for found in by_shingle.values():
        for i, a in enumerate(found):
            for b in found[:i]:
                if (b, a) in seen:
                    continue
                seen.add((b, a))
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((root(a), root(b)))
                    label[y] = x
    return {d: root(d) for d in sets}
