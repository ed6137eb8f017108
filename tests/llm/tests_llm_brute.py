"""Brute-force near-dedup for the pipeline's test."""

import re


def deduplicated(texts, width=5, percent=80):
    sets = {}
    for i, t in texts.items():
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    best, ids = {i: i for i in sets}, sorted(sets)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if best[a] < best[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    best[b], changed = best[a], True
    return {i for i in ids if best[i] == i}
