"""Plain versions of what the operators compute, one text at a time."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def secrets(text):
    text = text or ""
    found = []
    kinds = [("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16)]
    for n, (kind, pattern, group, least) in enumerate(kinds):
        found += [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    counts = Counter(n for _, n, _ in found)
    return counts[0], counts[1], counts[2], hashlib.sha256(",".join(x for *_, x in sorted(found)).encode()).hexdigest()


def shingles(text, size=5):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)}


def components(ids, links):
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return {i: root(i) for i in ids}


def near(texts):
    """doc_id -> (set size, component) by comparing all pairs; texts: doc_id -> text."""
    sets = {i: shingles(t) for i, t in texts.items()}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    shared = Counter()
    for own in by.values():
        for k, a in enumerate(own):
            for b in own[k + 1 :]:
                shared[a, b] += 1
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    label = components(texts, links)
    return {i: (len(s), label[i]) for i, s in sets.items()}
