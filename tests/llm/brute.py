"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import math
import re
import zlib


def words(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w]


def fold(doc_id, modulus):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


def shingles(text, size=5):
    w = words(text)
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def near_duplicates(rows, size=5, percent=80):
    """Sorted (doc_id, n_shingles, component_id) of (doc_id, text) rows, by all pairs that share a shingle."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    places = collections.defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            places[g].append(k)
    for k, (i, s) in enumerate(sets):
        both = collections.Counter(y for g in s for y in places[g] if y < k)
        for y, n in both.items():
            if i is not None and sets[y][0] is not None and 100 * n >= percent * (len(s) + len(sets[y][1]) - n):
                parent[root(k)] = root(y)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, len(s), least[root(k)] if i is not None else None) for k, (i, s) in enumerate(sets)), key=str)


def edit_inside(item, text):
    """Least edit distance of the item to any run of the text."""
    before = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        now = [i]
        for j, y in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return min(before)


def plain_words(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall("[a-z0-9\u0080-\U0010ffff]+", low)


def items_in(docs, items, rate=0.2, run=3):
    """Sorted (doc_id, item_id, edits) of items that stand in texts."""
    out = []
    for i, t in docs:
        own = plain_words(t)
        for k, item in items:
            need = plain_words(item)
            most = int(rate * len(need)) if len(need) >= 2 * run else 0
            if need and (d := edit_inside(need, own)) <= most:
                out.append((i, k, d))
    return sorted(out, key=str)


def _discounts(of_counts, upto=5):
    d = {r: 1.0 for r in range(1, upto + 1)}
    if not of_counts.get(1):
        return d
    spare = (upto + 1) * of_counts.get(upto + 1, 0) / of_counts[1]
    if spare < 1:
        for r in range(1, upto + 1):
            if of_counts.get(r):
                x = ((r + 1) * of_counts.get(r + 1, 0) / (r * of_counts[r]) - spare) / (1 - spare)
                d[r] = x if 0 < x <= 1 else 1.0
    return d


class Katz:
    """The model of the katz module with dictionaries."""

    def __init__(self, texts, symbols):
        tokens = [words(t) + ["</s>"] for t in texts]
        self.counts = collections.Counter(w for t in tokens for w in t)
        self.total, self.distinct = sum(self.counts.values()), len(self.counts)
        by_count = sorted(self.counts.values(), reverse=True)
        least = by_count[symbols] if len(by_count) > symbols else 0
        self.own = {w for w in self.counts if self.counts[w] > least}
        one = _discounts(collections.Counter(self.counts[w] for w in self.own))
        self.unigram = {w: self.counts[w] * one.get(self.counts[w], 1.0) for w in self.own}
        self.unigram.setdefault("</s>", float(self.counts["</s>"]))
        spare, total = self.total - sum(self.unigram.values()), self.total
        if spare <= 1e-12:
            spare, total = 1, total + 1
        self.unigram = {w: c / total for w, c in self.unigram.items()} | {"<unk>": spare / total}
        pairs = collections.Counter()
        for t in tokens:
            symbols_ = ["<s>", *map(self.symbol, t)]
            pairs.update(zip(symbols_, symbols_[1:]))
        self.two = _discounts(collections.Counter(pairs.values()))
        self.after = collections.defaultdict(dict)
        for (a, b), n in pairs.items():
            self.after[a][b] = n
        tail = [w for w in self.counts if self.symbol(w) == "<unk>"]
        self.tail_norm = sum(self.counts[w] for w in tail) + 0.5 * (len(tail) + 1)

    def symbol(self, w):
        return w if w in self.own or w == "</s>" else "<unk>"

    def p(self, a, b):
        if a not in self.after:
            return self.unigram.get(b, 0.0)
        seen = self.after[a]
        total, kept = sum(seen.values()), sum(n * self.two.get(n, 1) for n in seen.values())
        unseen = 1 - sum(self.unigram[w] for w in seen)
        norm = (total + 1 if kept >= total - 1e-12 else total) if unseen > 1e-12 else kept
        if b in seen:
            return seen[b] * self.two.get(seen[b], 1) / norm
        return (1 - kept / norm) / unseen * self.unigram.get(b, 0.0)

    def row(self, doc_id, text):
        w = words(text) + ["</s>"]
        base = sum(math.log10((self.counts[x] + 0.5) / (self.total + 0.5 * (self.distinct + 1))) for x in w)
        score, last = 0.0, "<s>"
        for x in w:
            s = self.symbol(x)
            score += math.log10(max(self.p(last, s), 1e-300)) + (math.log10((self.counts[x] + 0.5) / self.tail_norm) if s == "<unk>" else 0)
            last = s
        return doc_id, len(w), sum(self.counts[x] > 0 for x in w), self.total, base, score
