"""Plain Python twins of the operators, for small inputs."""

from __future__ import annotations

import random
import re
import zlib

BLANK = r"[^\x20\x09-\x0D]+"


def low(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return re.findall(BLANK, text or "")


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def measures(text: str | None) -> dict[str, int]:
    text = text or ""
    ws = words(text)
    grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(BLANK, x)]
    return {
        "n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
    }


def line_dedup(docs: list[tuple[int | None, str | None]]) -> list[tuple[int | None, str, int, int]]:
    key = lambda line: low(line).strip("\x20\x09\x0a\x0b\x0c\x0d")
    number = lambda i: float("-inf") if i is None else i
    where: dict[str, list] = {}
    for i, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                where.setdefault(k, []).append(number(i))
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(where.get(key(x), ())) < 3 or max(where[key(x)]) == number(i)]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


def shingles(text: str | None) -> set:
    ws = words(low(text or ""))
    return {tuple(ws)} - {()} if len(ws) < 5 else {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}


def near_duplicates(docs: list[tuple[int, str | None]], percent: int) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def bench_words(text: str | None) -> list[str]:
    return [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]


def leaks(docs: list[tuple[int, str | None]], items: list[tuple[int, str]]) -> set[tuple[int, int]]:
    out = set()
    for i, t in docs:
        ws = bench_words(t)
        for k, item in items:
            b = bench_words(item)
            if not b:
                continue
            for start in range(-len(b), len(ws)):
                same = [0 <= start + p < len(ws) and ws[start + p] == w for p, w in enumerate(b)]
                width = min(13, len(b))
                best = max(sum(same[p : p + width]) for p in range(len(b) - width + 1))
                if 100 * best >= 80 * width:
                    out.add((i, k))
    return out


def viterbi(text: str, pieces: dict[str, float], miss: float) -> float:
    """The best score of a whole marked text."""
    best = [0.0] + [float("-inf")] * len(text)
    longest = max(map(len, pieces))
    for end in range(1, len(text) + 1):
        for begin in range(max(0, end - longest), end):
            score = pieces.get(text[begin:end])
            if score is None and end - begin == 1:
                score = miss
            if score is not None and best[begin] + score > best[end]:
                best[end] = best[begin] + score
    return best[-1]


def random_text(rng: random.Random, n_lines: int = 4, vocabulary: int = 30) -> str:
    line = lambda: " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", ",", "é"]) for _ in range(rng.randrange(12)))
    return "\n".join(line() for _ in range(rng.randrange(n_lines + 1)))


#: Texts that operators must bear.
ODD = [None, "", " ", "\n", "\n\n \t\n", "a", "Ä ö ü\xa0x", "x" * 3000, "日本語 の テキスト 🎉", "a\x00b \x0b c", "\\<turn>&|", "word " * 4000]
