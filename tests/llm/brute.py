"""Plain versions of the operators SQL cannot express, and odd texts to try them on."""

from __future__ import annotations

import hashlib
import re


LONG = "Lorem ipsum dolor sit amet, +49 (30) 901820 und x@y.example.org wieder. " * 3000
TEXTS = [
    (1, "One line of words that stays\nand another line of words here", "a"),
    (2, "", "a"),
    (3, None, None),
    (None, "A document without an id and its own words", None),
    (None, None, "b"),
    (4, LONG, "b"),
    (5, "twice the same row with the same words in it", "a"),
    (5, "twice the same row with the same words in it", "a"),
    (6, "twice the same row with the same words in it", "b"),
    (7, "  \n\t \n", "c"),
    (8, "İstanbul ﬁ ² Ⅷ 日本語 \U0001f600\x1c end", "c"),
    (9, "password = 'abcdef123456' +1 (555) 123-4567 me@host.example.com 4111 1111 1111 1111, 10.0.0.255", "c"),
]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def luhn(number: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(number)):
        value = int(digit) * (1 + k % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def personal(text: str) -> list[tuple[str, int, int]]:
    def digits(found):
        return re.sub("[^0-9]", "", found)

    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return [(kind, *m.span()) for kind, pattern, good in kinds for m in re.finditer(pattern, text) if good(m[0])]


def secrets(text: str) -> list[tuple[str, int, int]]:
    words = "|".join(
        "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)
        for word in ("password", "passwd", "secret", "token", "api_?key")
    )
    assign = rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[kind], start, end) for start, kind, end in sorted(found)]


def written_out(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def shingles(text: str | None, size: int) -> set[tuple[str, ...]]:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return set()
    return {tuple(words[k : k + size]) for k in range(max(len(words) - size + 1, 1))}


def components(rows: list[tuple[int, str | None]], size: int, percent: int) -> dict[int, int]:
    """Least id reachable by links, for rows with different ids."""
    sets = {doc: shingles(text, size) for doc, text in rows}
    least = {doc: doc for doc in sets}

    def root(doc):
        while least[doc] != doc:
            doc = least[doc]
        return doc

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                one, other = sorted((root(a), root(b)))
                least[other] = one
    return {doc: root(doc) for doc in ids}


def merkle(rows: list[tuple]) -> list[tuple]:
    """For rows of (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof, folded root."""
    import zlib

    def one(value):
        if value is None:
            return "-"
        return f"{len(str(value).encode())}:{value}"

    def up(nodes, places):
        """Root of the nodes; appends each place's siblings and the way to put its digest back."""
        while len(nodes) > 1:
            for place in places:
                start, slot = place["at"] // 16 * 16, place["at"] % 16
                run = nodes[start : start + 16]
                place["proof"] += "".join(run[:slot] + run[slot + 1 :])
                place["fold"] = sha("".join([*run[:slot], place["fold"], *run[slot + 1 :]]))
                place["at"] //= 16
            nodes = [sha("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
        return nodes[0] if nodes else None

    trees = {}
    for row in rows:
        doc, *rest, text = row
        leaf = sha("".join(one(value) for value in row))
        fold = leaf
        if doc is not None and text is not None and zlib.crc32(str(doc).encode()) % 5 == 0:
            changed = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            fold = sha("".join(one(value) for value in (doc, *rest, changed)))
        trees.setdefault(row[1], []).append({"id": doc, "leaf": leaf, "fold": fold, "proof": ""})
    roots, every = [], []
    for rank, source in enumerate(sorted(trees, key=lambda s: (s is not None, (s or "").encode()))):
        places = sorted(trees[source], key=lambda x: (x["id"] is not None, x["id"] or 0, x["leaf"]))
        for k, place in enumerate(places):
            place["at"] = k
        roots.append(up([place["leaf"] for place in places], places))
        for place in places:
            place.update(at=rank, subroot=roots[-1])
        every += places
    root = up(roots, every)
    return [(x["id"], x["leaf"], x["subroot"], root, x["proof"], x["fold"]) for x in every]
