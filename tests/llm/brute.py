"""Plain versions of the contracts, one text at a time, for comparison with the operators."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def fingerprint(text):
    w = words((text or "").translate(ASCII_LOWER))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def simhash(rows):
    """{doc_id: (fingerprint, component)} by comparing every pair of fingerprints."""
    prints = {i: fingerprint(t) for i, t in rows}
    ids = defaultdict(list)
    for i, p in prints.items():
        ids[p].append(i)
    parent = {p: p for p in ids}

    def top(p):
        while parent[p] != p:
            p = parent[p]
        return p

    every = list(ids)
    for n, a in enumerate(every):
        for b in every[n + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[top(a)] = top(b)
    least = defaultdict(list)
    for p in every:
        least[top(p)] += ids[p]
    return {i: (f"{p:016x}", min(least[top(p)])) for i, p in prints.items()}


_ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)


def secrets(text):
    text, found = text or "", []
    for kind, (name, pattern, ok) in enumerate(
        (
            ("assign", _ASSIGN, lambda m: len(m[2]) >= 6),
            ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
            ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
        )
    ):
        found += [(m.start(), kind, m.end(), name) for m in pattern.finditer(text) if ok(m)]
    found.sort()
    n = Counter(x[3] for x in found)
    spans = ",".join(f"{name}:{a}:{b}" for a, _, b, name in found)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(spans.encode()).hexdigest(), spans


def warc(rows):
    out, last = {}, {}
    for i, html in rows:
        body = (html or "").encode()
        if len(body) >= 1000 and i is not None:
            last[body] = max(last.get(body, i), i)
    for i, html in rows:
        body = (html or "").encode()
        revisit = body in last and last[body] != i
        out[i] = (len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", last[body] if revisit else None)
    return out


def byte_repeats(rows, size=400):
    """[(doc_id, n_bytes, n_removed, n_spans, sha)] for each row."""
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + size] for b in texts for i in range(len(b) - size + 1))
    out = []
    for (doc_id, _), b in zip(rows, texts):
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc_id, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def word_repeats(rows, size=50):
    """[(doc_id, n_words, n_removed, sha)] for each row; null ids come last."""
    key = lambda i: float("inf") if i is None else i
    texts = [words(t) for _, t in rows]
    first: dict = {}
    for (i, _), w in zip(rows, texts):
        for a in range(len(w) - size + 1):
            x = tuple(w[a : a + size])
            first[x] = min(first.get(x, key(i)), key(i))
    out = []
    for (i, _), w in zip(rows, texts):
        gone = [False] * len(w)
        for a in range(len(w) - size + 1):
            if first[tuple(w[a : a + size])] < key(i):
                gone[a : a + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def url(text):
    """host, path, rule, verdict of the rule."""
    if text is None or "://" not in text:
        host = path = ""
    else:
        rest = text.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.translate(ASCII_LOWER)
    fits = [(len(h + p), h + p, v) for v, h, p in _RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, None))
    return host, path, rule, verdict


def targets(sizes):
    """{source: target} by water filling, round after round."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, out, free = sum(sizes.values()), {}, list(order)
    while free:
        level = (total - sum(out.values())) / sum(weight[s] for s in free)
        stop = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not stop:
            out |= {s: level * weight[s] for s in free}
            break
        out |= {s: 3.0 * sizes[s] for s in stop}
        free = [s for s in free if s not in stop]
    return out


def url_verdicts(urls, purity, levels=12):
    """Verdict of each URL: the rule's, else that of a tree of dictionaries, merged from the host down."""
    told = [url(u) for u in urls]
    leaves, of = {}, []
    for host, path, rule, verdict in told:
        for pattern in (r"(?<=/)[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?=/|$)", r"(?<=/)(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{8,}(?=/|$)", "[0-9]+"):
            path = re.sub(pattern, "*", path)
        segs = [x for x in path.split("/") if x]
        segs = tuple(segs[: levels - 1] + (["/".join(segs[levels - 1 :])] if segs[levels - 1 :] else []))
        of.append((host, segs))
        n = leaves.setdefault((host, segs), [0, 0])
        n[0] += rule is not None and verdict == "block"
        n[1] += rule is not None
    rejects = {}

    def total(some):
        return sum(leaves[x][0] for x in some), sum(leaves[x][1] for x in some)

    def merge(some, depth):
        branches = defaultdict(list)
        for x in some:
            branches[x[1][depth] if depth < len(x[1]) else ""].append(x)
        pb, pl = total(some)
        p = (pb + 1) / (pl + 2)
        pooled = defaultdict(list)
        for seg, group in branches.items():
            b, n = total(group)
            like = len(branches) > 1 and abs((b + 1) / (n + 2) - p) <= 1.96 * math.sqrt(p * (1 - p) * (1 / (n + 2) + 1 / (pl + 2)))
            for x in group:
                pooled["*" if like else seg].append(x)
        for group in pooled.values():
            ended = [x for x in group if depth >= len(x[1])]
            more = [x for x in group if depth < len(x[1])]
            if ended:
                b, n = total(ended)
                rejects.update(dict.fromkeys(ended, ((b + 1) / (n + 2) >= purity)))
            if more:
                merge(more, depth + 1)

    hosts = defaultdict(list)
    for x in leaves:
        hosts[x[0]].append(x)
    for group in hosts.values():
        merge(group, 0)
    return [verdict if rule is not None else "block" if rejects[x] else "allow" for (_, _, rule, verdict), x in zip(told, of)]


def _xx(*values):
    """Spark's xxhash64 of strings, longs and ints, unsigned."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=v < 0) if not isinstance(v, bool) else int(v).to_bytes(4, "little"), h)
    return h


def _signed(h):
    return h - (1 << 64) * (h >> 63)


def quality_scores(docs, labels, buckets=1 << 13, quantile=0.01, least=50, fixed=-0.15):
    """{doc_id: (score, threshold)} by counting n-grams in dictionaries, and the threshold. ``labels``: (doc_id, quality, toxic)."""
    good = sorted({i for i, q, t in labels if i is not None and q == 1 and not t}, key=lambda i: (_signed(_xx(i)), i))[:20_000]
    held = {i for i in good if _xx(i, True) % 2}
    grams = {}
    for i, text in docs:
        h = [_signed(_xx(w)) for w in words(text)]
        grams[i] = [x % buckets for x in h] + [_signed(_xx(a, b)) % buckets for a, b in zip(h, h[1:])]
    raw = Counter(g for gs in grams.values() for g in gs)

    def scores(fit):
        target = Counter(g for i in fit for g in grams.get(i, ()))
        if not target:
            return dict.fromkeys(grams, 0.0)
        a, b = target.total() + buckets, raw.total() + buckets
        table = [round(math.log((target[g] + 1) / a) - math.log((raw[g] + 1) / b), 6) for g in range(buckets)]
        return {i: round(sum(table[g] for g in gs) / max(1, len(gs)), 6) for i, gs in grams.items()}

    texts = dict(docs)
    if len(held) >= least:
        got = scores([i for i in good if i not in held])
        passed = sorted(got[i] for i in held if i in got and not quality(texts[i])[-1])
        if len(passed) >= least:
            at = quantile * (len(passed) - 1)
            lo = int(at)
            return got, passed[lo] + (at - lo) * (passed[min(lo + 1, len(passed) - 1)] - passed[lo])
    return scores(good), fixed


def pairs(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return list(zip(w, w[1:]))


def license_units(text):
    lines = text.split("\n")
    out = [("line", i, x) for i, x in enumerate(lines) if x.strip()]
    starts = [i for i, x in enumerate(lines) if x.strip() and (i == 0 or not lines[i - 1].strip())]
    for i in starts:
        end = next((j for j in range(i, len(lines)) if not lines[j].strip()), len(lines))
        if end - i > 1:
            out.append(("paragraph", i, " ".join(lines[i:end])))
    return out + [("document", 0, text)] * (len(starts) > 1)


def shingle_set(text, n=5):
    w = words((text or "").translate(ASCII_LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def jaccard_components(rows, percent=80):
    """[(doc_id, set size, smallest id reachable)] in the order of the rows, by comparing all pairs of distinct sets."""
    sets = [frozenset(shingle_set(t)) for _, t in rows]
    every = list(dict.fromkeys(s for s in sets if s))
    parent = list(range(len(every)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(every):
        for j in range(i):
            n = len(a & every[j]) if min(len(a), len(every[j])) * 100 >= percent * max(len(a), len(every[j])) else 0
            if n and 100 * n >= percent * (len(a) + len(every[j]) - n):
                parent[top(i)] = top(j)
    number = {s: n for n, s in enumerate(every)}
    ids = defaultdict(list)
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            ids[top(number[s])].append(i)
    return [(i, len(s), min(ids[top(number[s])], default=None) if s else i) for (i, _), s in zip(rows, sets)]


def collocations(rows, least=100, longest=5, best=2000):
    """Rows of the contract from ``(lang, text)``, every phrase counted."""
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(ASCII_LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {p[i : i + k] for p, a in often.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if a >= counts[p[i : i + k]]}
        found = []
        for p, a in often.items():
            if p not in inside:
                s, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:best], 1)]
    return sorted(out)


def fill_middle(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[at : at + 8], 16) for at in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"
