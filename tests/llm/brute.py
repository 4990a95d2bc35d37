"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

UPPER = {k: k + 32 for k in range(65, 91)}


def components(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))) \
        if words else frozenset()


def near_duplicates(docs):
    """{doc_id: (n_shingles, component_id)}; all pairs of documents that share a shingle."""
    sets = {i: shingles(t) for i, t in docs}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    links = [(a, b) for a, b in pairs
             if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    found = components(links, sets)
    return {i: (len(s), found[i]) for i, s in sets.items()}


def without_repeats(docs, n=100):
    """{doc_id: (n_bytes, n_removed, n_spans, kept sha256)} by a set of all n-byte strings."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        data = (text or "").encode()
        cover = bytearray(len(data))
        for k in range(len(data) - n + 1):
            window = data[k:k + n]
            if window in seen:
                cover[k:k + n] = b"\x01" * n
            seen.add(window)
        kept = bytes(x for x, c in zip(data, cover, strict=True) if not c)
        spans = sum(1 for k, c in enumerate(cover) if c and (k == 0 or not cover[k - 1]))
        out[i] = (len(data), sum(cover), spans, hashlib.sha256(kept).hexdigest())
    return out


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items, window=10):
    """{doc_id: (n_words, n_hit, [item ids])}."""
    phrases = defaultdict(set)
    for name, text in items:
        words = WORD.findall((text or "").translate(UPPER))
        if words:
            n = min(window, len(words))
            for k in range(len(words) - n + 1):
                phrases[tuple(words[k:k + n])].add(str(name))
    sizes = {len(p) for p in phrases}
    out = {}
    for i, text in docs:
        words = WORD.findall((text or "").translate(UPPER))
        hit, names = set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                found = phrases.get(tuple(words[k:k + n]))
                if found:
                    hit |= set(range(k, k + n))
                    names |= found
        out[i] = (len(words), len(hit), sorted(names))
    return out


def without_phrases(text, items, window=10):
    """The text without the words of phrases, and what stands between such words."""
    lower = (text or "").translate(UPPER)
    spans = [m.span() for m in WORD.finditer(lower)]
    words = [lower[a:b] for a, b in spans]
    phrases = set()
    for _, item in items:
        own = WORD.findall((item or "").translate(UPPER))
        n = min(window, len(own))
        phrases |= {tuple(own[k:k + n]) for k in range(len(own) - n + 1)} if own else set()
    hit = set()
    for n in {len(p) for p in phrases}:
        for k in range(len(words) - n + 1):
            if tuple(words[k:k + n]) in phrases:
                hit |= set(range(k, k + n))
    out, at = [], 0
    k = 0
    while k < len(words):
        if k in hit:
            stop = k
            while stop + 1 in hit:
                stop += 1
            out.append(text[at:spans[k][0]])
            at = spans[stop][1]
            k = stop
        k += 1
    return "".join(out) + (text or "")[at:]


def boilerplate_cut(docs, ratio=0.1, least=5):
    """{doc_id: text} for (doc_id, host, text)."""
    total, held = defaultdict(int), defaultdict(int)
    for _, host, text in docs:
        total[host] += 1
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
            held[host, line] += 1
    return {i: None if text is None else "\n".join(
        x for x in text.split("\n") if host is None or not x.strip(" ")
        or held[host, x.strip(" ")] < least
        or held[host, x.strip(" ")] <= ratio * total[host]) for i, host, text in docs}
