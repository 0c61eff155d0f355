"""Plain versions of the operators, written from their contracts."""

import hashlib
import re
from collections import defaultdict

BLANK = " \t\n\x0b\x0c\r"
LOWER = {k: k + 32 for k in range(65, 91)}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def embeddings(rows, threshold=0.95):
    import numpy as np

    good = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = []
    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= threshold:
                links.append((a, b))
    root, n = components([i for i, _ in rows], links), defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {(i, n[i], root[i], root[i] == i) for i, _ in rows}


def simhash(text, k=3):
    import xxhash

    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(rows, k=3):
    prints = {i: simhash(t, k) for i, t in rows}
    ids = sorted(prints)
    root = components(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    return {(i, f"{prints[i]:016x}", root[i]) for i in ids}


def similar(rows):
    """The smallest doc_id each is linked to by similarity 0.8 or more on five-word sets, and the links."""
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    held = defaultdict(list)
    for i, s in sets.items():
        for x in s or {()}:
            held[x].append(i)
    pairs = {(a, b) if a < b else (b, a) for ids in held.values() for a in ids for b in ids if a != b}
    links = [(a, b) for a, b in pairs if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    return components(list(sets), links), links


def substrings(rows, n=13):
    grams = defaultdict(lambda: 1 << 62)
    split = {i: words(t) for i, t in rows}
    for i, w in split.items():
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            grams[g] = min(grams[g], i)
    out = set()
    for i, w in split.items():
        gone = {k + o for k in range(len(w) - n + 1) if grams[tuple(w[k : k + n])] < i for o in range(n)}
        out.add((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    return {(i, min(g)[1], len(g), i == min(g)[1], sha(norm)) for norm, g in groups.items() for _, i in g}


def lines(rows):
    split = {i: (t or "").split("\n") for i, t in rows}
    held = defaultdict(set)
    for i, ls in split.items():
        for x in ls:
            held[x.strip(BLANK).translate(LOWER)].add(i)
    out = set()
    for i, ls in split.items():
        kept = [x for x in ls if len(k := x.strip(BLANK).translate(LOWER)) < 20 or len(held[k]) < 3 or max(held[k]) == i]
        out.add((i, len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    return out


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def personal(text):
    out = []
    for k, (kind, p) in enumerate(KINDS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    out.sort()
    return (*(sum(s[3] == kind for s in out) for kind in KINDS), sha(",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in out)))


def disclosed(texts, threshold=0.5, support=3, chance=0.1):
    """Of different texts: {text: places of its disclosing terms}. Entities are values, kinds and "any"."""
    import math

    import regex

    term = regex.compile(r"(?<![\p{L}\p{M}\p{N}])\p{L}[\p{L}\p{M}]*+(?!\p{N})")
    values, found = {}, {}
    for t in texts:
        own = set()
        for kind, p in KINDS.items():
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                    own.add(f"{kind}:{m[0].lower() if kind in ('email', 'ip') else d}")
        values[t], at = frozenset(own), 0
        found[t] = []
        for gap in re.split("(" + re.sub(r"\((?!\?)", "(?:", KINDS["email"]) + ")", t):
            if not re.fullmatch(KINDS["email"], gap):
                found[t] += [(at + m.start(), at + m.end(), m[0].lower()) for m in term.finditer(gap)]
            at += len(gap)
    held = {t for t in texts if values[t]}
    plain = [t for t in texts if not values[t]]
    records = {values[t] for t in held}
    kinds_of = lambda v: {x.split(":")[0] for x in v} | {"any"}
    terms = {w for t in held for _, _, w in found[t]}
    n_plain = {w: 0 for w in terms}
    for t in plain:
        for w in {w for _, _, w in found[t]} & terms:
            n_plain[w] += 1
    told = set()
    n, every = len(records) + len(plain), len(held) + len(plain)
    kinds = [*KINDS, "any"]
    limit = math.log(max(1, len(terms)) * len(kinds) / chance)
    texts_of, records_of = defaultdict(set), defaultdict(set)
    for t in held:
        for w in {w for _, _, w in found[t]}:
            texts_of[w].add(t)
            records_of[w].add(values[t])
    for k in kinds:
        of = sum(k in kinds_of(v) for v in records)
        for w in terms:
            both, whole = sum(k in kinds_of(v) for v in records_of[w]), len(records_of[w]) + n_plain[w]
            if both and math.log(both * n / (of * whole)) / max(math.log(n / of), 1e-9) >= threshold:
                e = whole * of / n
                if both > e and both * math.log(both / e) - both + e >= limit:
                    told.add((k, w))
    for v in {x for t in held for x in values[t]}:
        of = {t for t in held if v in values[t]}
        if len(of) >= support:
            for w in {w for t in of for _, _, w in found[t]}:
                both, whole = len(of & texts_of[w]), len(texts_of[w]) + n_plain[w]
                if both >= support and math.log(both * every / (len(of) * whole)) / max(math.log(every / len(of)), 1e-9) >= threshold:
                    told.add((v, w))
    return {t: [(a, b) for a, b, w in found[t] if any((e, w) in told for e in values[t] | kinds_of(values[t]))] if values[t] else [] for t in texts}


def host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    found = None
    for verdict, r in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")):
        of, rest = r.split("/", 1)
        if (host == of or host.endswith("." + of)) and path.startswith("/" + rest) and (not found or len(r) > len(found[0])):
            found = (r, verdict)
    return found or (None, None)
