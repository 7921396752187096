"""Plain Python versions of the operators, for whole small tables."""

import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_duplicates(docs):
    """{doc_id: (n_shingles, component)} by counting the common shingles of all pairs that have any."""
    sets = {d: shingle_set(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    classes = defaultdict(list)
    for d, s in sets.items():
        if s:
            classes[frozenset(s)].append(d)
    for own in classes.values():
        for d in own:
            root[find(d)] = find(min(own))
    index = defaultdict(list)
    for s, own in classes.items():
        both = Counter(x for g in s for x in index[g])
        for x, n in both.items():
            if 100 * n >= 75 * (len(s) + len(sets[x]) - n):
                root[find(own[0])] = find(x)
        for g in s:
            index[g].append(own[0])
    least = defaultdict(list)
    for d in sets:
        least[find(d)].append(d)
    comp = {d: min(own) for own in least.values() for d in own}
    return {d: (len(s), comp[d]) for d, s in sets.items()}


KINDS = {
    "assign": re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def base_spans(text):
    keep = {"assign": lambda m: len(m[2]) >= 12, "access": lambda m: len(m[0]) >= 18, "hex": lambda m: len(m[0]) >= 16}
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(KINDS.items()) for m in p.finditer(text or "") if keep[k](m)]
    return [(k, s, e) for s, _, e, k in sorted(found)]


def kept_lines(docs, min_chars=40, min_docs=5):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    where = defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                where[key(x)].add(d)
    keeper = {k: max(v) for k, v in where.items() if len(v) >= min_docs}
    return {d: "\n".join(x for x in (t or "").split("\n") if keeper.get(key(x), d) == d) for d, t in docs}


def letters_of(word):
    return [x for x in re.split(r"[^A-Za-z]+", word) if x]


def random_spans(text, base, n_tokens, max_ratio):
    """Spans of random strings as the rules say them; ``n_tokens`` counts the tokens of a string."""
    marks, found, at = "+/_=-", [], 0
    good = lambda c: c.isascii() and (c.isalnum() or c in marks)

    def changes(x):
        kinds = [c.isdigit() for c in x]
        return sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))

    def named(x):
        return all(changes(y) <= 2 for y in re.split(r"[+/_=-]", x))

    def stamp(x):
        y = x.removesuffix("Z")
        if not (len(y) in range(15, 19) and y[8] == "T" and (y[:8] + y[9:]).isdigit()):
            return False
        return y[:2] in ("19", "20") and 1 <= int(y[4:6]) <= 12 and 1 <= int(y[6:8]) <= 31

    def digest(x):
        if stamp(x):
            return True
        if x[:2] == "0x":
            return len(x) - 2 in (32, 40, 56, 64, 96, 128) and set(x[2:]) <= set("0123456789abcdefABCDEF")
        one_case = set(x) <= set("0123456789abcdef") or set(x) <= set("0123456789ABCDEF")
        return len(x) in (32, 40, 56, 64, 96, 128) and one_case

    def uuid(x):
        return [len(y) for y in x.split("-")] == [8, 4, 4, 4, 12] and set(x) <= set("0123456789abcdefABCDEF-")

    def ends_key(lo, hi):
        x = text[lo:hi]
        if any(s <= lo and hi <= e for _, s, e in base) or uuid(x) or digest(x):
            return True
        words = letters_of(x)
        n = sum(map(len, words))
        return len(x) >= 4 if not n else n >= 3 and named(x) and n / sum(map(n_tokens, words)) > max_ratio

    while at < len(text):
        if not good(text[at]):
            at += 1
            continue
        end = at
        while end < len(text) and good(text[end]):
            end += 1
        if end - at >= 16:
            stretches, i = [], at
            while i < end:
                if text[i] in marks:
                    i += 1
                    continue
                j = i + 36
                if not (i > at and text[i - 1].isalnum()) and j <= end and uuid(text[i:j]) and not (j < end and text[j].isalnum()):
                    stretches.append((i, j))
                else:
                    j = i
                    while j < end and text[j] not in marks:
                        j += 1
                    stretches.append((i, j))
                i = j
            groups, own = [], []
            for lo, hi in stretches:
                if own and "=" in text[own[-1][1] : lo]:
                    groups, own = [*groups, own], []
                if ends_key(lo, hi):
                    groups, own = [*groups, own], []
                else:
                    own = [*own, (lo, hi)]
            for own in filter(None, [*groups, own]):
                lo, hi = own[0][0], own[-1][1]
                if hi - lo < 16:
                    lo = at if all(c in "+/_-" for c in text[at:lo]) else lo
                    hi = end if all(c in marks for c in text[hi:end]) else hi
                x = text[lo:hi]
                words = letters_of(x)
                n = sum(map(len, words))
                if len(x) < 16 or max(h - l for l, h in own) < 6 or not n:
                    continue
                ratio = n / sum(map(n_tokens, words))
                if x.isalpha() and x.isupper():
                    sequence = set(x) <= set("ACGTUN") or set(x) <= set("ACDEFGHIKLMNPQRSTVWY")
                    hit = not sequence and ratio <= 1.89 and n / n_tokens(x.lower()) <= 1.89
                elif named(x):
                    one = all(w.islower() or w.isupper() or (w[0].isupper() and not any(c.isupper() for c in w[1:])) for w in words)
                    hit = n >= 4 and ratio <= (1.5 if one else 1.8)
                else:
                    hit = ratio <= max_ratio and len(x) / n_tokens(x) <= max_ratio
                if hit:
                    found.append(("random", lo, hi))
        at = end
    return found


MASK = 2**64 - 1


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def letter_vector(code, dims=1024, seed=7):
    """+1 and -1 of a letter, by its bytes."""
    words = dims // 64
    raw = b"".join(mixed(mixed((code + 1) * words + w) ^ (seed * 0x9E3779B97F4A7C15 & MASK)).to_bytes(8, "little") for w in range(words))
    return np.array([1 if byte >> (7 - k) & 1 else -1 for byte in raw for k in range(8)])


class Language:
    """Trigram profiles, one trigram after the other."""

    def __init__(self):
        self.known, self.letter = {}, {}

    def gram(self, three):
        if three not in self.known:
            for c in three:
                if c not in self.letter:
                    self.letter[c] = letter_vector(0 if c == "\0" else ord(c))
            a, b, c = (self.letter[x] for x in three)
            self.known[three] = np.roll(a, 16) * np.roll(b, 8) * c
        return self.known[three]

    def bundle(self, text):
        """The sum of a text's trigrams and their number."""
        s = re.sub("\0+", "\0", "\0" + "".join(x.lower()[0] if x.isalpha() else "\0" for x in text or "") + "\0")
        grams = Counter(s[i : i + 3] for i in range(len(s) - 2)) if s.strip("\0") else {}
        return sum((n * self.gram(g) for g, n in grams.items()), np.zeros(1024)), sum(grams.values())

    def learn(self, rows):
        sums, counts = {}, Counter()
        for text, lang in rows:
            if text is not None and lang is not None:
                v, n = self.bundle(text)
                sums[lang] = sums.get(lang, 0) + v
                counts[lang] += n
        self.langs = sorted(x for x in sums if counts[x])
        protos = np.array([sums[x] / counts[x] for x in self.langs])
        self.mean = protos.mean(axis=0)
        self.protos = protos - self.mean

    def predict(self, text):
        v, n = self.bundle(text)
        if not n:
            return "und", 0.0
        v = v / n - self.mean
        cosine = self.protos @ v / np.linalg.norm(self.protos, axis=1) / np.linalg.norm(v)
        k = int(cosine.argmax())
        return self.langs[k], max(0.0, cosine[k])
