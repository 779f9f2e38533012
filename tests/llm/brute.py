"""Plain versions of the operators' results, for small tables."""

import hashlib
import re
from collections import defaultdict
from itertools import combinations

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def near_duplicates(rows, size, part, whole):
    """{doc_id: (n_shingles, component_id, kept)} of (doc_id, text) rows."""
    sets = {}
    for doc, text in rows:
        words = SPACED.findall((text or "").translate(LOWER))
        sets[doc] = {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
    label = {d: d for d in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    postings = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            postings[x].append(d)
    pairs = {p for docs in postings.values() if len(docs) > 1 for p in combinations(sorted(docs), 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if whole * both >= part * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def repeats(rows, window):
    """{doc_id: (n_words, n_removed, kept_sha256)} of (doc_id, text) rows."""
    texts = {d: SPACED.findall(t or "") for d, t in rows}
    first, gone = {}, {d: set() for d in texts}
    for d in sorted(texts):
        words = texts[d]
        for i in range(len(words) - window + 1):
            name = tuple(words[i : i + window])
            if name in first:
                gone[d].update(range(i, i + window))
            else:
                first[name] = (d, i)
    out = {}
    for d, words in texts.items():
        kept = " ".join(w for i, w in enumerate(words) if i not in gone[d])
        out[d] = (len(words), len(gone[d]), hashlib.sha256(kept.encode()).hexdigest())
    return out


def overlaps(rows, items, window):
    """{doc_id: (n_words, n_hit, n_items, items_sha256, contaminated)}."""
    windows = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall((text or "").translate(LOWER))
        for i in range(max(1, len(words) - window + 1) if words else 0):
            windows[tuple(words[i : i + window])].add("" if item is None else str(item))
    sizes = sorted({len(w) for w in windows})
    out = {}
    for d, text in rows:
        words = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                ids = windows.get(tuple(words[i : i + n]))
                if ids:
                    hit.update(range(i, i + n))
                    found |= ids
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[d] = (len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words))
    return out


def licences(rows, phrases):
    """{doc_id: (n_words, n_base, first_word, last_word, base_labels)}."""
    out = {}
    for d, text in rows:
        words = ALNUM.findall((text or "").translate(LOWER))
        places, labels = [], set()
        for phrase, label in phrases.items():
            p = phrase.split()
            at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        out[d] = (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
    return out
