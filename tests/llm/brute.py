"""Plain versions of the operators' contracts, written apart from them."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from array import array
from collections import Counter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def crc(ids) -> int:
    return zlib.crc32(array("I", ids).tobytes())


def library_ids(path: str, texts: list[str]) -> list[list[int]]:
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def token_files(rows, path):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for r, ids in zip(order, library_ids(path, [r[1] or "" for r in order]), strict=True):
        ids = [*ids, 2]
        out.append((r[0], start, len(ids), crc(ids)))
        start += len(ids)
    return out


def substrings(rows, length=35):
    words = [SPACED.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def licenses(rows):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    out = []
    for r in rows:
        w = ALNUM.findall(lower(r[1] or ""))
        at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        out.append((r[0], len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))))
    return out


def license_spans(text, templates):
    """(label, start, end, share) of each copy of a template: a plain count of equal grams on each diagonal."""
    w = ALNUM.findall(lower(text or ""))
    out = []
    for label, template in templates:
        t = ALNUM.findall(lower(template))
        k, least = (5, 0.5) if len(t) >= 24 else (min(2, len(t)), 0.75)
        grams = len(t) - k + 1
        hits, places = {}, {}
        for j in range(grams):
            places.setdefault(tuple(t[j : j + k]), []).append(j)
        for i in range(len(w) - k + 1):
            for j in places.get(tuple(w[i : i + k]), ()):
                hits.setdefault(i - j, []).append((i, j))
        islands, group = [], []
        for d in [*sorted(d for d in hits if 64 * len(hits[d]) >= grams), None]:
            if group and (d is None or d - group[-1] > 3):
                held = [p for g in group for p in hits[g]]
                ats = {j for _, j in held}
                islands.append((min(i for i, _ in held), max(i for i, _ in held) + k, min(ats), max(ats), len(held), ats))
                group = []
            group.append(d)
        chains = []
        for x in sorted(islands, key=lambda x: x[:3]):
            last = chains[-1][-1] if chains else None
            if x[4] < 3 or len(t) < 24:
                chains.insert(0, [x])
            elif last and last[4] >= 3 and x[0] - last[1] <= len(t) // 2 and x[2] > last[3] - 3:
                chains[-1].append(x)
            else:
                chains.append([x])
        for chain in chains:
            whole = (min(x[0] for x in chain), max(x[1] for x in chain), set().union(*(x[5] for x in chain)))
            holds = lambda x: len(x[-1]) / grams >= least and x[1] - x[0] <= math.ceil(len(t) * 1.5)  # noqa: B023, E731
            out += [(label, x[0], x[1], len(x[-1]) / grams) for x in ([whole] if holds(whole) else filter(holds, chain))]
    return out


def folded(text):
    """Words without edge marks and case; those without anything else are left out."""
    found = [w.strip("\"'()[]{}<>.,;:!?¿¡…") for w in SPACED.findall(text)]
    return [w.lower() for w in found if w]


def stands_in(item, text):
    return any(text[i : i + len(item)] == item for i in range(len(text) - len(item) + 1) if text[i] == item[0])


def covered(item, text):
    """The most words of the item that stand in order in one stretch of the text of at most one and a half times its length."""
    best, size = 0, len(item) * 3 // 2 + 4
    wanted = set(item)
    for start in range(0, max(len(text) - size // 2, 1), max(size // 2, 1)):
        part = text[start : start + 2 * size]
        if sum(w in wanted for w in part) <= best:
            continue
        row = [0] * (len(part) + 1)
        for w in item:
            before = 0
            for j, x in enumerate(part, 1):
                before, row[j] = row[j], max(row[j], row[j - 1], before + (w == x))
        best = max(best, row[-1])
    return best


def token_counts(rows, path, limit=4096):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    counts = [len(library.encode(r[1] or "")) for r in rows]
    return [(r[0], len((r[1] or "").encode()), n, n > limit) for r, n in zip(rows, counts, strict=True)]


def shingles(text, k=5):
    w = SPACED.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def jaccard(rows, k=5, percent=80):
    sets = [shingles(r[1], k) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return [(r[0], len(s), least.get(root(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


def quality(rows, window=8):
    out = []
    for r in rows:
        text = r[1] or ""
        w = SPACED.findall(text)
        seen = Counter(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
        again = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                again.update(range(i, i + window))
        lines = Counter(x for x in text.split("\n") if SPACED.search(x))
        failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
        out.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), sum(n - 1 for n in lines.values()), len(again), failed))
    return out


def perplexities(rows, order=5):
    """Perplexity of a character of each text under an interpolated modified Kneser-Ney model of its language."""
    out = []
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2] or "", []).append(r[1] or "")
    models = {}
    for lang, texts in by_lang.items():
        grams = Counter(g for t in texts for g in _grams(t, order))
        levels = {order: grams}
        for n in range(order - 1, 0, -1):
            levels[n] = Counter(g[1:] for g in levels[n + 1])
        p = {"": 1 / max(len(levels[1]), 1)}
        for n in range(1, order + 1):
            seen = Counter(levels[n].values())
            d = {k: v for k, v in ((1, 0.5), (2, 0.75), (3, 0.9))}
            if seen[1] and seen[2]:
                y = seen[1] / (seen[1] + 2 * seen[2])
                for k in d:
                    value = k - (k + 1) * y * seen[k + 1] / seen[k] if seen[k] else 0
                    d[k] = value if 0 < value < k else d[k]
            total, kept = Counter(), Counter()
            for g, c in levels[n].items():
                total[g[:-1]] += c
                kept[g[:-1]] += d[min(c, 3)]
            p |= {g: (c - d[min(c, 3)]) / total[g[:-1]] + kept[g[:-1]] / total[g[:-1]] * p[g[1:]] for g, c in levels[n].items()}
        models[lang] = p
    for r in rows:
        found = [math.log(models[r[2] or ""][g]) for g in _grams(r[1] or "", order)]
        out.append(math.exp(-sum(found) / max(len(found), 1)))
    return out


def _grams(text, order):
    padded = "\n" * (order - 1) + text
    return [padded[i : i + order] for i in range(len(text))]


URL = re.compile(r"(?i:https?://|ftp://)([A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]+)")
SECRET = re.compile(r"""(?i:api_key|apikey|api-key|secret|token|password|passwd|access_key)[\x20"']{0,2}[:=][\x20]?["']?([A-Za-z0-9+/_.-]{16,})""")


def added_pii(text):
    """Addresses of the web and secrets, by expressions over the whole text."""
    out = [("url", m.start(), m.start(1) + len(m[1].rstrip(".,;:!?)'"))) for m in URL.finditer(text)]
    return out + [("secret", m.start(1), m.end(1)) for m in SECRET.finditer(text)]


def _luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def pii(rows):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and _luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    out = []
    for r in rows:
        found = [(k, m.start(), m.end()) for k, p, good in kinds for m in re.finditer(p, r[1] or "") if good(m)]
        n = Counter(k for k, _, _ in found)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        out.append((r[0], *(n[k] for k, _, _ in kinds), hashlib.sha256(said.encode()).hexdigest()))
    return out


def collocations(rows, longest=5, least=100, most=2000):
    """rows: (id, text, lang, ...)."""
    seen, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            seen.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {x: a for x, a in seen.items() if a >= least and len(x[1]) > 1}
    gone = {(lang, w[i : i + k]) for (lang, w), b in often.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if b >= seen[lang, w[i : i + k]]}
    best = {}
    for (lang, w), a in often.items():
        if (lang, w) not in gone:
            cuts = [(1000 * a * total[lang] // (seen[lang, w[:k]] * seen[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            best.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), seen[lang, w[:k]], seen[lang, w[k:]]))
    return [(lang, i + 1, w.decode(), -a, left, right, total[lang], -score) for lang, found in best.items() for i, (score, a, w, left, right) in enumerate(sorted(found)[:most])]


def _xx(value: int, seed: int = 42) -> int:
    """Spark's hash of a long, as a signed number."""
    import xxhash

    return _signed(xxhash.xxh64_intdigest((value & (1 << 64) - 1).to_bytes(8, "little"), seed & (1 << 64) - 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def terms(text: str) -> set[int]:
    import regex
    import xxhash

    return {_signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w}


def fingerprint(text: str, band: set[int], lexicons: int = 64) -> tuple:
    """(level, wide, narrow) as sets of signatures, or the text itself if it has no term in the lexicons."""
    import xxhash

    def integer(value: int, seed: int) -> int:
        return _signed(xxhash.xxh64_intdigest((value & (1 << 32) - 1).to_bytes(4, "little"), seed & (1 << 64) - 1))

    own = terms(text)
    at = max(6, math.floor(math.log2(max(len(own), 1))) + 1)
    held = [{t for t in own & band if t % (1 << v) < lexicons} for v in (at, at + 1)]
    if not held[0]:
        return (text,)
    out = []
    for v, ts in zip((at, at + 1), held, strict=True):
        places = {}
        for t in sorted(ts):
            places.setdefault(t % lexicons, []).append(t)
        signatures = set()
        for place, of in places.items():
            x = _xx(place, integer(v, 42))
            for t in of:
                x = _xx(t, x)
            signatures.add(f"{x & 0xFFFFFFFF:08X}")
        out.append(signatures)
    return (at, *out)


def likeness(a: tuple, b: tuple) -> float:
    if len(a) == 1 or len(b) == 1:
        return float(a == b)
    pairs = {0: [(a[1], b[1]), (a[2], b[2])], 1: [(a[1], b[2])], -1: [(a[2], b[1])]}.get(a[0] - b[0], [])
    size = sum(len(x) + len(y) for x, y in pairs)
    return 2 * sum(len(x & y) for x, y in pairs) / size if size else 0.0


def fingerprints(rows):
    """(doc_id, n_chars, edited_sha256, near_edited, near_next, fingerprint, edited fingerprint), the rows in the order of their places."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, -(rows[i][0] or 0), i))
    text = [rows[i][1] or "" for i in order]
    counts = Counter(t for x in text for t in terms(x))
    band = {t for t, n in counts.items() if max(2.0, len(rows) * 1e-5) <= n <= max(2.0, len(rows) * 0.1)}
    prints, out = [fingerprint(x, band) for x in text], []
    for i, at in enumerate(order):
        cut, following = len(text[i]) // 3, (i + 1) % len(text)
        edited = text[i][: len(text[i]) - cut] + text[following][:cut]
        changed = fingerprint(edited, band)
        out.append((rows[at][0], len(text[i]), hashlib.sha256(edited.encode()).hexdigest(), likeness(prints[i], changed), likeness(prints[i], prints[following]), prints[i], changed))
    return out


def hard_negatives(rows, positives=5, negatives=3):
    """rows: (vec_id, embedding, label)."""
    kept = []
    for i, (key, vector, label) in enumerate(rows):
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((key, i, (label + 1) % 10 if key % 7 == 0 else label, [math.floor(256 * x) for x in vector]))
    out = []
    for a in kept:
        if a[0] % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[3], b[3], strict=False)), b[0], b[1], b[2]) for b in kept if b[1] != a[1])
        for score, key, _, _ in [s for s in scored if s[3] == a[2]][:positives]:
            band = [s for s in scored if s[3] != a[2] and 50 * -score <= 100 * -s[0] <= 95 * -score]
            out += [(a[0], key, i + 1, n[1], -score, -n[0]) for i, n in enumerate(band[:negatives])]
    return out
