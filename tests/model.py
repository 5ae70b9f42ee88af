"""A plain model of the library's semantics, written from their description: the tests' brute force."""

from __future__ import annotations

import math
import re
import unicodedata

N = 1_024_908_267_229


def osa(a: str, b: str) -> int:
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i][j] = i + j
                continue
            best = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, d[i - 2][j - 2] + 1)
            d[i][j] = best
    return d[-1][-1]


def reach(n: int, k: int, thresholds) -> int:
    if thresholds is None:
        return k
    steps = [i for i, t in enumerate(thresholds) if n >= t]
    return k + steps[-1] if steps else 0


class Model:
    def __init__(self, words: dict[str, int], bigrams: dict[str, int] | None = None, count_threshold: int = 1, thresholds=None):
        self.words, self.bigrams = words, bigrams or {}
        self.low = min(self.bigrams.values()) if self.bigrams else (1 << 63) - 1
        self.indexed = {t for t, c in words.items() if c >= count_threshold and (not thresholds or len(t) >= thresholds[0])}
        self.longest = max(map(len, self.indexed), default=0)

    def lookup(self, text: str, verbosity: str, k: int, thresholds=None) -> list[tuple[str, int, int]]:
        q, k = text.lower(), reach(len(text), k, thresholds)
        if len(q) - k > self.longest:
            return []
        found = [(q, 0, self.words[q])] if q in self.words else []
        if k:
            found += [(t, d, self.words[t]) for t in self.indexed if t != q and (d := osa(q, t)) <= k]
        found.sort(key=lambda f: (f[1], -f[2], f[0]))
        if verbosity == "all":
            return found
        found = [f for f in found if f[1] == found[0][1]]
        return found[:1] if verbosity == "top" else found

    def top(self, text: str, k: int, thresholds=None):
        return (self.lookup(text, "top", k, thresholds) or [None])[0]

    def _part(self, w: str, k: int):
        own = self.top(w, k)
        if own and (own[1] == 0 or len(w) == 1):
            return own
        options = [(own[1], -own[2], 0, own[0])] if own else []
        for j in range(1, len(w)):
            a, b = self.top(w[:j], k), self.top(w[j:], k)
            if not a or not b:
                continue
            term = f"{a[0]} {b[0]}"
            d = osa(w, term)
            d = d if d <= k else k + 1
            if term in self.bigrams:
                c = self.bigrams[term]
                if own:
                    c = max(c, own[2] + 2) if term == w else max(c, own[2] + 1) if own[0] in (a[0], b[0]) else c
                elif term == w:
                    c = max(c, max(a[2], b[2]) + 2)
            else:
                c = min(self.low, int(a[2] / N * b[2]))
            options.append((d, -c, j, term))
        if not options:
            return w, k + 1, int(10 / 10 ** len(w))
        d, c, _, term = min(options)
        return term, d, -c

    def compound(self, text: str, k: int) -> tuple[str, int, int]:
        words, parts, merged = re.findall(r"[^\W]+(?:['’_]|[^\W])*|['’_]+[^\W]*", text.lower()), [], False
        for i, w in enumerate(words):
            if i and not merged and (c := self.top(words[i - 1] + w, k)):
                last = parts[-1]
                own = self.top(w, k) or (w, k + 1, int(10 / 10 ** len(w)))
                d = last[1] + own[1]
                if c[1] + 1 < d or (c[1] + 1 == d and c[2] > int(last[2] / N * own[2])):
                    parts[-1], merged = (c[0], c[1] + 1, c[2]), True
                    continue
            parts.append(self._part(w, k))
            merged = False
        term, p = " ".join(x[0] for x in parts).strip(), float(N)
        for x in parts:
            p *= x[2] / N
        return term.lower(), osa(text.lower(), term), int(p)

    def segment(self, text: str, k: int) -> tuple[str, int, float]:
        x = unicodedata.normalize("NFKC", text).replace("-", "")
        best: list[tuple | None] = [None] * (len(x) + 1)
        for e in range(1, len(x) + 1):
            for j in range(max(0, e - self.longest), e):
                part, sep = x[j:e], 1
                if part[0].isspace():
                    part, sep = part[1:], 0
                ed = part.count(" ")
                part = part.replace(" ", "")
                if hit := self.top(part, k):
                    lp = math.log10(hit[2] / N)
                    ed += hit[1]
                    part = hit[0] if hit[1] else part
                else:
                    lp = math.log10(10 / (N * 10 ** len(part)))
                    ed += len(part)
                if j == 0:
                    best[e] = (part, ed, lp)
                    continue
                s, d, p = best[j]
                old = best[e]
                if e - j == self.longest or d + sep + ed < old[1] or (old[1] in (d + ed, d + sep + ed) and old[2] < p + lp):
                    if part == "’" or (len(part) == 1 and part in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
                        best[e] = (s + part, d + ed, p + lp)
                    else:
                        best[e] = (f"{s} {part}", d + sep + ed, p + lp)
        return best[len(x)] if x and best[len(x)] else ("", 0, 0.0)
