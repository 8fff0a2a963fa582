"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re

import regex
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def measures(text):
    t = text or ""
    w = WORD.findall(t)
    seen = {}
    for k in range(len(w) - 7):
        seen.setdefault(tuple(w[k : k + 8]), []).append(k)
    repeated = {p for at in seen.values() if len(at) > 1 for k in at for p in range(k, k + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated)


def fingerprint(text, k=4):
    w = WORD.findall((text or "").translate(UPPER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, most=4, k=4):
    """{position: smallest id} of rows (id, text)."""
    fps = [fingerprint(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                root[find(i)] = find(j)
    groups = {}
    for i, (own, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(own)
    return fps, [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(rows))]


def shingle_set(text, k=5):
    w = WORD.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def similar(rows, most=0.8, k=5):
    """Pairs of positions whose texts are that similar, those without words among them."""
    sets = [shingle_set(t, k) for _, t in rows]
    alike = lambda x, y: len(x & y) >= most * len(x | y)
    return [(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j])]


def closed(n, pairs):
    """The component of each of n positions, told by its smallest one."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(n)]


def targets(totals, weights=(5, 2, 1), most=3):
    names = sorted(s for s in totals if s is not None) + ([None] if None in totals else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, left, open_ = {}, sum(totals.values()), list(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > most * totals[s]]
        if not over:
            out |= {s: level * weight[s] for s in open_}
            break
        out |= {s: most * totals[s] for s in over}
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def contamination(text, items, window=10):
    """(n_words, n_hit, item ids) for items (id, text)."""
    w, hit, met = item_words(text), set(), set()
    for own, item in items:
        iw = item_words(item)
        n = min(len(iw), window)
        runs = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if iw else set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in runs:
                hit.update(range(k, k + n))
                met.add(own)
    return len(w), len(hit), met


def luhn(digits):
    each = [int(c) for c in reversed(digits)]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(each)) % 10 == 0


def _digits(x):
    return re.sub("[^0-9]", "", x)


PERSONAL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda x: 14 <= len(_digits(x)) <= 19 and luhn(_digits(x))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 10 <= len(_digits(x)) <= 15),
}


def personal(text):
    """(start, kind's place, end) sorted."""
    return sorted((m.start(), k, m.end()) for k, (pattern, test) in enumerate(PERSONAL.values()) for m in re.finditer(pattern, text or "") if test(m[0]))


KEYED = regex.compile(r"(?<![\p{L}\p{N}_.-])(\p{L}[\p{L}\p{N}_.-]*)[ \t]*[=:][ \t]*[\"']?([^\s\"'=:,;|<>]+)")


def opaque(value):
    return len(value) >= 16 and re.fullmatch("[A-Za-z0-9_+/-]+", value) is not None and len(re.findall("[0-9_+/-]+(?=[A-Za-z])", value)) >= 3


def masked(text):
    out = list(text or "")
    for a, _, b in personal(text):
        out[a:b] = "0" * (b - a)
    return "".join(out)


def keyed(text):
    return [(m[1].translate(UPPER), m[2], m.start(2), m.end(2)) for m in KEYED.finditer(masked(text))]


def disclosing_keys(texts, disclosure=0.9):
    """{key: share}"""
    texts, holding, opaques = {t or "" for t in texts}, {}, {}
    for t in texts:
        for key, value, _, _ in keyed(t):
            holding.setdefault(key, set()).add(t)
            if opaque(value):
                opaques.setdefault(key, set()).add(t)
    secret = (len({t for own in opaques.values() for t in own}) + 0.5) / (len(texts) + 1)
    shares = {key: math.log((len(own) + 0.5) / (len(holding[key]) + 1) / secret) / math.log(1 / secret) for key, own in opaques.items()}
    return {key: share for key, share in shares.items() if share >= disclosure}


def secrets(text, keys):
    return [(a, b) for key, _, a, b in keyed(text) if key in keys]


def listed(spans):
    names = list(PERSONAL)
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
