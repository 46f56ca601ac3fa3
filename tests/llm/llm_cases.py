"""Small tables with every awkward row, and plain versions of the operators."""

from __future__ import annotations

import hashlib
import re
import zlib

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 7919}x{i % 13}" for i in range(40_000))
COPY = " ".join(f"copy{i}" for i in range(120))

#: doc_id, text, lang, source, n_chars, and columns named like what operators make
DOCUMENTS = [
    (1, COPY, "en", "a", 1, "x", 5, True),
    (2, COPY, "en", "a", 1, "x", 5, True),
    (2, COPY, "en", "a", 1, "x", 5, True),
    (3, COPY.replace("copy60", "other"), None, "a", None, None, None, None),
    (4, None, "en", "b", 0, "y", 1, False),
    (5, "", "fr", "b", 0, "y", 1, False),
    (6, " \n\t\n", "xx", None, 4, "y", 1, False),
    (7, LONG, "de", "c", len(LONG), "z", 2, None),
    (8, "a line that is long enough\nshort\nA LINE that is long enough  \n\nlast one of them", "es", "c", 1, "z", 2, True),
    (9, "a line that is long enough\né ß 😀 token = \"abcdef0123456789abcdef01\"", "en", "c", 1, "z", 2, True),
    (None, COPY, "en", "d", 1, "z", 2, True),
    (None, "an own text without any id and with a few words in it", "en", "d", 1, "z", 2, True),
]
DOCUMENT_TYPES = ("doc_id long, text string, lang string, source string, n_chars long, rule string, n_words long, kept boolean")


def documents(spark, rows=DOCUMENTS):
    return spark.createDataFrame(rows, DOCUMENT_TYPES)


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lines_kept(rows):
    """{row place: (lines, dropped, kept text)}; null ids come last and are one document."""
    upper = {i: i + 32 for i in range(65, 91)}
    keys, least, holders = [], {}, {}
    for doc, text in rows:
        doc = doc if doc is not None else 1 << 63
        mine = [line.strip(" \t\n\x0b\f\r").translate(upper) for line in (text or "").split("\n")]
        keys.append((doc, mine))
        for k in mine:
            if len(k) >= 10:
                least[k] = min(least.get(k, doc), doc)
                holders.setdefault(k, set()).add(doc)
    out = []
    for (doc, mine), (_, text) in zip(keys, rows):
        lines = (text or "").split("\n")
        stay = [x for x, k in zip(lines, mine) if not (len(k) >= 10 and len(holders[k]) > 1 and least[k] < doc)]
        out.append((len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def passages_kept(rows, window=50):
    """[(words, removed, kept text)] in the order of the rows; ids are not null."""
    first = {}
    found = [(doc, words(text)) for doc, text in rows]
    for doc, w in found:
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, w in found:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < doc:
                gone[i:i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def base_secrets(text):
    """Sorted (start, rank, kind, stop)."""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    for rank, kind, pattern, least in ((1, "access", r"AKIA[A-Z0-9]+", 20), (2, "hex", r"[0-9a-f]+", 24)):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(out)


def quality_counts(text):
    """words, their characters, symbols, repeated lines, words in repeated windows."""
    text = text or ""
    w = words(text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    grams = {}
    for i in range(len(w) - 4):
        grams.setdefault(tuple(w[i:i + 5]), []).append(i)
    covered = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def shingle_sets(rows, k=5):
    out = {}
    for doc, text in rows:
        w = words(text)
        n = min(k, len(w))
        out[doc] = frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else frozenset()
    return out


def near_classes(rows, similarity=0.8):
    """{doc: least doc of its group}, every pair compared."""
    sets = shingle_sets(rows)
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    holders = {}
    for d, s in sets.items():
        for x in s or [()]:
            holders.setdefault(x, []).append(d)
    for group in holders.values():
        for i, a in enumerate(group):
            for b in group[:i]:
                x, y = top(a), top(b)
                if x != y:
                    both = len(sets[a] & sets[b])
                    if not sets[a] or both >= similarity * len(sets[a] | sets[b]):
                        root[max(x, y)] = min(x, y)
    return {d: top(d) for d in sets}


def edit_distance(a, b, most):
    """Least edits between a and any beginning of b."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def checksum(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
