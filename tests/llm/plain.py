"""Plain versions of the operators for small inputs, and a table of awkward rows."""

import collections
import hashlib
import math
import re

from pyspark.sql import types as T

LONG = "lorem ipsum dolor sit amet " * 8000
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "Hello world."), (5, "Hello world."), (5, "Hello world."), (None, None), (None, "Hello world."),
    (6, "a"), (7, "1234 !!"), (8, LONG), (9, LONG + "x"), (10, "é🙂漢字 ﷽ ‍ " * 50), (11, "tie tie tie\ntie tie tie\n" * 30), (12, "\x00\x01 <|endoftext|>\r\n"),
]
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("mark", T.StringType()),
    T.StructField("kept", T.StringType()), T.StructField("key", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("items", T.StringType()),
    T.StructField("n", T.StringType()), T.StructField("passed__", T.StringType()),
])


def awkward(spark, rows=None):
    """Nulls in every column, repeated rows, long texts, and columns named like the operators' own."""
    rows = AWKWARD if rows is None else rows
    full = [(i, t, None if k % 3 == 0 else "en", None if k % 2 else "s", None if t is None else len(t), None, "x", "y", None, "z", "w", "v", "u", "p") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def digits(v):
    return re.sub("[^0-9]", "", v)


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m.group())) <= 15),
}
SECRETS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 8),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 16),
    "hex": (r"[0-9a-f]+", lambda m: len(m.group()) >= 32),
}


def base_spans(text, kinds):
    """Counts by kind and the digest of the base spans."""
    found, counts = [], []
    for rank, (kind, (pattern, ok)) in enumerate(kinds.items()):
        own = [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if ok(m)]
        found += own
        counts.append(len(own))
    return (*counts, sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))))


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def contaminated(docs, items, size=10):
    """doc index -> (words, hit words, items, digest, any)."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    windows = collections.defaultdict(set)
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            windows[tuple(w[i : i + size])].add(str(name) if name is not None else "")
    out = []
    for _, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[i : i + n])):
                    found |= ids
                    hit |= set(range(i, i + n))
        out.append((len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def simhash(text):
    import xxhash

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered(text)) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fingerprints, distance=2):
    """Fingerprint -> smallest fingerprint reachable over links."""
    parent = {f: f for f in fingerprints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = sorted(parent)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= distance:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {f: top(f) for f in values}


def repeated_bytes(docs, length=400):
    count = collections.Counter()
    raws = [(i, (t or "").encode()) for i, t in docs]
    for _, raw in raws:
        count.update(raw[p : p + length] for p in range(len(raw) - length + 1))
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if count[raw[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, sha(bytes(x for x, g in zip(raw, gone) if not g))))
    return out


def base_quality(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = collections.Counter(triples)
    repeat = {j for i, t in enumerate(triples) if count[t] > 1 for j in range(i, i + 3)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(repeat), failed


class KneserNey:
    """Interpolated modified Kneser-Ney over the characters of words, from dictionaries."""

    def __init__(self, words, order=5):
        self.order = order
        raw = collections.Counter()
        for w, n in words.items():
            s = f"\x02{w}\x03"
            for k in range(1, order + 1):
                for i in range(len(s) - k + 1):
                    raw[s[i : i + k]] += n
        before = collections.Counter(g[1:] for g in raw if len(g) > 1)
        self.count = {g: n if len(g) == order or g[0] == "\x02" else before[g] for g, n in raw.items() if g != "\x02"}
        self.discount = {}
        for k in range(1, order + 1):
            c = collections.Counter(n for g, n in self.count.items() if len(g) == k)
            n1, n2, n3, n4 = (c[i] for i in range(1, 5))
            y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
            self.discount[k] = [min(i - 1e-6, max(0.05, i - (i + 1) * y * b / a)) if a and b else 0.5 * i for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        self.total, self.left = collections.Counter(), collections.Counter()
        for g, n in self.count.items():
            self.total[g[:-1]] += n
            self.left[g[:-1]] += self.cut(g)
        self.other = 1 / (sum(len(g) == 1 for g in self.count) + 1)

    def cut(self, g):
        return self.discount[len(g)][min(self.count[g], 3) - 1]

    def p(self, h, c):
        lower = self.p(h[1:], c) if h else self.other
        if h not in self.total:
            return lower
        own = (self.count[h + c] - self.cut(h + c)) / self.total[h] if h + c in self.count else 0.0
        return own + self.left[h] / self.total[h] * lower

    def perplexity(self, text):
        logs = [math.log(self.p(s[max(0, i - self.order + 1) : i], s[i])) for w in (text or "").split() for s in [f"\x02{w}\x03"] for i in range(1, len(s))]
        return math.exp(-sum(logs) / len(logs)) if logs else None


def _digest(*parts):
    return sha("".join(parts))


def _encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def merkle(rows, arity=3):
    """rows (doc_id, source, lang, n_chars, text) -> rows of the contract, in any order."""

    def tree(leaves):
        """(root, for each leaf its steps (left, right))."""
        steps, under, nodes = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
        while len(nodes) > 1:
            new, new_under = [], []
            for a in range(0, len(nodes), arity):
                run = nodes[a : a + arity]
                for j in range(len(run)):
                    for leaf in under[a + j]:
                        steps[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
                new.append(_digest(*run))
                new_under.append([x for u in under[a : a + arity] for x in u])
            nodes, under = new, new_under
        return nodes[0], steps

    import zlib

    sources = collections.defaultdict(list)
    for row in rows:
        sources[row[1]].append((row[0] is not None, row[0] or 0, _digest(*map(_encoded, row)), row))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in names}
    if not names:
        return []
    root, tops = tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        for (_, _, leaf, row), steps in zip(sorted(sources[s], key=lambda x: x[:3]), trees[s][1]):
            path = steps + top
            text = row[4]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            now = _digest(*map(_encoded, (*row[:4], text)))
            for left, right in path:
                now = _digest(left, now, right)
            out.append((row[0], leaf, trees[s][0], root, sha("".join(left + right for left, right in path)), now, now == root))
    return out


def spelling(docs, least=5, length=6):
    """word -> (form, root, n, n_near, form_n), from all pairs of a small vocabulary by deletions."""
    import zlib

    count = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    count = {w: n for w, n in count.items() if n >= least and len(w) >= length}
    near = collections.defaultdict(set)
    gap = collections.defaultdict(set)
    for w in count:
        for k in range(len(w)):
            gap[w[:k], w[k + 1 :]].add(w)
            if (shorter := w[:k] + w[k + 1 :]) in count:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in gap.values():
        for w in group:
            near[w] |= group - {w}
    out = {}
    for w, n in count.items():
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        out[w] = best if best is not None and count[best] >= 5 * n else None

    def root(w):
        while out[w] is not None:
            w = out[w]
        return w

    return {w: (f, root(w), count[w], len(near[w]), count[f] if f else None) for w, f in out.items()}
