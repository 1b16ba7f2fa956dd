"""Plain Python versions of what the operators compute, straight from their contracts."""

import base64
import hashlib
import re
from collections import Counter

import xxhash

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def quality(text):
    t = text or ""
    w = SPACE_WORD.findall(t)
    seen = Counter(zip(w, w[1:], w[2:]))
    hit = {p + k for p, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if SPACE_WORD.search(x)]
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return dict(n_words=len(w), word_chars=sum(map(len, w)), n_symbols=sum(c in "#*$%&|<>" for c in t), n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(hit), base_failed=failed)


def luhn(digits):
    s = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def mod97(iban):
    x = re.sub("[^A-Z0-9]", "", iban)
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


#: By kind: weight, what a context word adds, the context words, the least score.
PII = {
    "email": (0.9, 0.1, "email e-mail mail contact write kontakt correo", 0),
    "ip": (0.6, 0.3, "host server address adresse ip", 0),
    "card": (0.7, 0.3, "card visa credit karte carte tarjeta", 0),
    "phone": (0.7, 0.3, "phone telephone call tel mobile fax anruf", 0),
    "iban": (0.8, 0.2, "iban bank account konto compte cuenta", 0),
    "ssn": (0.3, 0.5, "ssn social_security tax_id", 0.5),
}


def pii(text):
    t, every, out, spans = text or "", {}, {}, []
    n = lambda m: len(re.sub("[^0-9]", "", m.group()))
    every["email"] = list(re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t))
    every["ip"] = list(re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t))
    every["card"] = list(re.finditer(r"[0-9]([\x20-]?[0-9])+", t))
    every["phone"] = list(re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t))
    every["iban"] = list(re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", t))
    every["ssn"] = list(re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", t))
    holds = {
        "email": lambda m: True,
        "ip": lambda m: all(int(x) <= 255 for x in m.group().split(".")),
        "card": lambda m: 16 <= n(m) <= 19 and luhn(re.sub("[^0-9]", "", m.group())),
        "phone": lambda m: 8 <= n(m) <= 15,
        "iban": lambda m: 15 <= len(m.group().replace(" ", "")) <= 34 and mod97(m.group()) == 1,
        "ssn": lambda m: m.group()[:3] not in ("000", "666") and m.group()[0] != "9" and m.group()[4:6] != "00" and m.group()[7:] != "0000",
    }
    for kind, ms in every.items():
        weight, near, context, least = PII[kind]
        out[kind] = [m for m in ms if holds[kind](m)]
        for i, m in enumerate(ms):
            before = t[ms[i - 1].end() if i else 0 : m.start()][-40:]
            after = t[m.end() : ms[i + 1].start() if i + 1 < len(ms) else len(t)][:40]
            around = f"{before} {after}".lower()
            found = any(re.search(rf"(?<![^\W_]){re.escape(c.replace('_', ' '))}(?![^\W_])", around) for c in context.split())
            score = round(weight + near * found, 2)
            if m in out[kind] and score >= least:
                spans.append((kind, m.start(), m.end(), score))
    base = ("email", "ip", "card", "phone")
    return {f"n_{k}": len(out[k]) for k in base} | {"base_sha256": sha(",".join(f"{k}:{m.start()}:{m.end()}" for k in base for m in out[k])), "spans": ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans), "scores": ",".join(str(s) for *_, s in spans)}


def secrets(text):
    t, found = text or "", []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t, re.I | re.A):
        found += [("assign", m)] * (len(m.group(2)) >= 8)
    found += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
    found += [("hex", m) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 32]
    kinds = ("assign", "access", "hex")
    found.sort(key=lambda x: (x[1].start(), kinds.index(x[0])))
    return {f"n_{k}": sum(x == k for x, _ in found) for k in kinds} | {"base_sha256": sha(",".join(f"{k}:{m.start()}:{m.end()}" for k, m in found))}


def unpacked(raw):
    """What data in one of the formats holds, in all its streams; None if it is in none."""
    import bz2
    import lzma
    import zlib

    import zstandard

    makers = {b"\x1f\x8b": lambda: zlib.decompressobj(31), b"\x78": zlib.decompressobj, b"BZh": bz2.BZ2Decompressor, b"\xfd7zXZ": lzma.LZMADecompressor, b"\x28\xb5\x2f\xfd": lambda: zstandard.ZstdDecompressor().decompressobj()}
    out = None
    while raw and (make := next((m for k, m in makers.items() if raw.startswith(k)), None)):
        try:
            d = make()
            out = (out or b"") + d.decompress(raw)
        except Exception:
            break
        raw = d.unused_data
    return out


def secret_spans(text, above=()):
    """Every layer opened where it stands, by recursion; each code point of a layer knows the places it comes from."""
    found = set()
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        found |= {("assign", *m.span())} if len(m.group(2)) >= 8 else set()
    found |= {("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16}
    found |= {("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32}
    layers = []  # bytes, each with its (start, end)
    escape = re.compile(r"%([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
    for t in re.finditer(r"\S+", text):
        if escape.search(t.group()):
            one, at = [], t.start()
            while at < t.end():
                m = escape.match(text, at)
                raw = text[at].encode() if not m else chr(int(m[2], 16)).encode() if m[2] else bytes([int(m[1] or m[3], 16)])
                end = m.end() if m else at + 1
                one += [(b, at, end) for b in raw]
                at = end
            layers.append((one, True))
    for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}", text):
        body = m.group().rstrip("=").replace("-", "+").replace("_", "/")
        if len(body) % 4 != 1:
            raw = base64.b64decode(body + "=" * (-len(body) % 4))
            layers.append(([(b, m.start() + i * 4 // 3, min(m.start() + (i * 4 + 4) // 3, m.end() - 1) + 1) for i, b in enumerate(raw)], False))
    for one, sure in layers:
        raw = bytes(b for b, _, _ in one)
        while (more := unpacked(raw)) is not None:
            sure, one, raw = True, [(b, min(x[1] for x in one), max(x[2] for x in one)) for b in more], more
        try:
            below, at = raw.decode(), []
            for c in below:
                n = sum(len(x) for x in at)
                at.append(one[n : n + len(c.encode())])
        except UnicodeDecodeError:
            if not sure:
                continue
            below, at = raw.decode("latin-1"), [[x] for x in one]
        if below and below not in above and below != text and (sure or all(c.isprintable() or c in "\t\r\n" for c in below)):
            for kind, a, b in secret_spans(below, (*above, text)):
                part = [x for c in at[a:b] for x in c]
                found.add((kind if kind.startswith("decoded") else f"decoded_{kind}", min(x[1] for x in part), max(x[2] for x in part)))
    return found


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def windows(text, n=13):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near(doc, window, slop):
    return any(all(x in doc[s + o : s + o + slop + 1] for o, x in enumerate(window)) for s in range(len(doc)))


def contamination(docs, items, n=13, slop=2):
    """docs, items: lists of (id, text)."""
    by: dict = {}
    for i, t in items:
        for x in windows(t, n):
            by.setdefault(x, set()).add(i)
    lengths = {len(x) for x in by}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k in lengths:
            for p in range(len(w) - k + 1):
                if (x := tuple(w[p : p + k])) in by:
                    hit |= set(range(p, p + k))
                    found |= by[x]
        close = found.union(*(i for x, i in by.items() if len(x) == n and x[0] in w and near(w, x, slop)))
        yield dict(doc_id=d, n_near=len(close), n_words=len(w), n_hit=len(hit), n_items=len(found), items_sha256=sha(",".join(sorted(map(str, found)))), contaminated=bool(hit) and 20 * len(hit) >= len(w))


def fingerprint(text):
    w = SPACE_WORD.findall((text or "").translate(LOWER))
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, radius=4):
    """prints: {doc_id: fingerprint}. The smallest doc_id that each reaches."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if (prints[ids[a]] ^ prints[ids[b]]).bit_count() <= radius:
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    return {i: find(i) for i in ids}


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def licenses(text):
    w, at = words(text), []
    for p, label in PHRASES.items():
        q = p.split()
        at += [(i, label) for i in range(len(w)) if w[i : i + len(q)] == q]
    return dict(n_words=len(w), n_base=len(at), first_word=min(at)[0] if at else None, last_word=max(at)[0] if at else None, base_labels=",".join(sorted({x for _, x in at})))


def license_spans(text, templates, k, slack, least, share):
    """(label, start, end, share) by diagonals, one text and template after another, and plain tables for the common subsequence."""
    w, out = words(text), []
    for label, notice in templates:
        t = words(notice)
        hits = sorted((i - j, i, j) for i in range(len(w) - k + 1) for j in range(len(t) - k + 1) if w[i : i + k] == t[j : j + k])
        bands: list = []
        for h in hits:
            if not bands or h[0] - bands[-1][-1][0] > slack:
                bands.append([])
            bands[-1].append(h)
        for b in bands:
            of = len(t) - k + 1
            if len({j for _, _, j in b}) < max(1, -(-(of * least * 10) // 10)):
                continue
            start, end = min(i for _, i, _ in b), max(i for _, i, _ in b) + k
            span = w[start:end]
            table = [[0] * (len(t) + 1) for _ in range(len(span) + 1)]
            for x in range(len(span)):
                for y in range(len(t)):
                    table[x + 1][y + 1] = table[x][y] + 1 if span[x] == t[y] else max(table[x][y + 1], table[x + 1][y])
            s = 2 * table[-1][-1] / (len(t) + len(span))
            if s >= share:
                out.append((label, start, end, s))
    return out
