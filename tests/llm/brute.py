"""Plain versions of the operators, for small inputs."""

import re

import xxhash


def key(line):
    line = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)


def line_dedup(docs, least=20, documents=3):
    """{id: text} to {id: (lines, dropped, kept text)}."""
    held = {}
    for i, text in docs.items():
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                held.setdefault(key(line), set()).add(i)
    out = {}
    for i, text in docs.items():
        split = (text or "").split("\n")
        kept = [x for x in split if len(key(x)) < least or len(held[key(x)]) < documents or max(held[key(x)]) == i]
        out[i] = (len(split), len(split) - len(kept), "\n".join(kept))
    return out


def fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, budget=4):
    """{id: fingerprint} to {id: smallest id reachable}."""
    ids, root = sorted(prints), {}
    for start in ids:
        if start in root:
            continue
        queue = [start]
        root[start] = start
        while queue:
            at = queue.pop()
            for i in ids:
                if i not in root and (prints[i] ^ prints[at]).bit_count() <= budget:
                    root[i] = start
                    queue.append(i)
    return root


def least_edits(pattern, text):
    """Of the pattern to any stretch of the text, by the plain table."""
    column = list(range(len(pattern) + 1))
    best = column[-1]
    for c in text:
        before, column[0] = column[0], 0
        for i, p in enumerate(pattern, 1):
            before, column[i] = column[i], min(before + (p != c), column[i] + 1, column[i - 1] + 1)
        best = min(best, column[-1])
    return best


def normal(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).strip()
