"""Plain versions of what the operators compute."""

import collections
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def rule_counts(text):
    text = text or ""
    own = words(text)
    runs = collections.Counter(tuple(own[i:i + 8]) for i in range(len(own) - 7))
    covered = {j for i in range(len(own) - 7) if runs[tuple(own[i:i + 8])] > 1 for j in range(i, i + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def shingles(text):
    own = words((text or "").translate(LOWER))
    if len(own) >= 5:
        return {tuple(own[i:i + 5]) for i in range(len(own) - 4)}
    return {tuple(own)} if own else set()


def near_components(rows):
    """doc_id -> smallest id reachable over links of 75 per cent."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def sentence(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def near_copies(seed=5):
    """Texts with exact and near copies around the threshold, short and empty ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, at = [], 0
    for _ in range(25):
        base = sentence(rng, rng.randint(3, 120), vocabulary).split()
        for changes in (0, 0, 1, 2, 4, 8):
            text = list(base)
            for _ in range(changes):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((at, " ".join(text)))
            at += 1
    rng.shuffle(rows)
    return [*rows, (at, ""), (at + 1, None), (at + 2, "  \n "), (at + 3, "one two"), (at + 4, "One\tTWO")]
