"""Second computations of corpus operators, in plain Python over whole small tables."""

import math
import re

from tripweave.llm import decontamination, quality

EDGE = "\"'`.,;:!?()[]{}<>"


def kind_of(word, opens):
    """(placeholder or None, whether it is one inside a sentence, the word without its edge)."""
    bare = word.strip(EDGE)
    low = bare.lower()
    measure = re.fullmatch(r"(\d[\d.,]*)([a-z]+)", low)
    if re.fullmatch(r"\d[\d.,:/]*(st|nd|rd|th)?%?", bare):
        return "number", True, low
    if low in decontamination.UNITS:
        return "unit", True, low
    if measure and measure[2] in decontamination.UNITS:
        return "both", True, low
    if re.fullmatch(r"[^\W\d_][^\W\d_A-Z][^\W\d_]*(-[^\W\d_]+)*", bare) and bare[0].isupper() and bare[1].islower():
        return None if opens else "name", True, low
    return None, False, low


def template(text):
    words = (text or "").split()
    ends = [re.search(r"[.!?:]$", re.sub(r"[\"')\]]+$", "", w)) is not None for w in words]
    return [kind_of(w, i == 0 or ends[i - 1]) for i, w in enumerate(words)]


def window(words, at, size):
    """(key, slots) of the window: its template, or its words where more than half are slots."""
    part = words[at : at + size]
    if 2 * sum(k is not None for k, _, _ in part) > size:
        return ("words", *[w for _, _, w in part]), [w for _, free, w in part if free]
    return ("template", *[(k, None if k else w) for k, _, w in part]), [w for k, _, w in part if k]


def leaks(docs, items, size=8, least=13, least_item=4):
    """{(doc_id, item_id): (words_matched, item_words, consistent, contaminated)}."""
    found = {}
    items = {(i, t) for i, t in items if i is not None}
    for doc_id, text in {(i, t) for i, t in docs if i is not None}:
        here = template(text)
        ours = [window(here, p, size) for p in range(len(here) - size + 1)]
        plain = [w for _, _, w in here]
        for item_id, item in items:
            there = template(item)
            n = len(there)
            results = []
            if n < size:
                wanted = [w for _, _, w in there]
                if n and any(plain[p : p + n] == wanted for p in range(len(plain) - n + 1)):
                    results.append((n >= least_item, True, n, n))
            theirs = [window(there, i, size) for i in range(n - size + 1)]
            lines = {}
            for p, (key, slots) in enumerate(ours):
                for i, (other, values) in enumerate(theirs):
                    if key == other:
                        at, fills = lines.setdefault(p - i, (set(), set()))
                        at.update(range(i, i + size))
                        fills.update(zip(values, slots, strict=True))
            for at, fills in lines.values():
                agree = len({a for a, _ in fills}) == len(fills) == len({b for _, b in fills})
                enough = len(at) >= min(least, max(n - 1, size)) and n >= least_item
                results.append((agree and enough, agree, len(at), n))
            if results:
                best = max(results)
                now = (best[2], best[3], best[1], best[0])
                old = found.get((doc_id, item_id))
                key = lambda r: (r[3], r[2], r[0], r[1])
                found[doc_id, item_id] = now if old is None else max(now, old, key=key)
    return found


def strength(groups, centres):
    """Method of moments: what the prior of groups {key: (n, s)} around centres is worth."""
    n = sum(g[0] for g in groups.values())
    if n == 0 or len(groups) < 2:
        return 1e6
    mean = sum(g[1] for g in groups.values()) / n
    spread = sum(g[0] * (g[1] / g[0] - centres[k]) ** 2 for k, g in groups.items())
    free = n - sum(g[0] ** 2 for g in groups.values()) / n
    between = (spread - (len(groups) - 1) * mean * (1 - mean)) / max(free, 1e-9)
    if between <= mean * (1 - mean) * 1e-6:
        return 1e6
    return min(max(mean * (1 - mean) / between - 1, 1.0), 1e6)


def judged(docs, weights, base, threshold=quality.THRESHOLD):
    """[(doc_id, evidence, prior, posterior, kept)] of rows (doc_id, text, site, path)."""
    rows = []
    for doc_id, text, site, path in docs:
        x = quality.measures(text)
        score = base + sum(w * v for w, v in zip(weights, x, strict=True))
        score = max(min(score, 20.0), -20.0) if x[0] > 0 else 0.0
        rows.append((doc_id, score, 1 / (1 + math.exp(-score)), site, path))
    paths, sites = {}, {}
    for _, _, p, site, path in rows:
        for groups, key in ((paths, (site, path)), (sites, site)):
            n, s = groups.get(key, (0, 0.0))
            groups[key] = (n + 1, s + p)
    share = sum(s for _, s in sites.values()) / max(1, len(rows))
    pull = strength(sites, dict.fromkeys(sites, share))
    shrunk = {k: (s + pull * share) / (n + pull) for k, (n, s) in sites.items()}
    worth = strength(paths, {k: shrunk[k[0]] for k in paths})
    out = []
    for doc_id, score, p, site, path in rows:
        n, s = paths[site, path]
        prior = (s - p + worth * shrunk[site]) / (n - 1 + worth)
        held = min(max(prior, 1e-6), 1 - 1e-6)
        posterior = 1 / (1 + math.exp(-(score + math.log(held / (1 - held)))))
        out.append((doc_id, score, prior, posterior, posterior >= threshold))
    return out
