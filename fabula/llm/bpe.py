"""Vectorised pre-tokenisation and BPE over whole batches, shared by operators 6 and 7.

Every batch is one array of code points. Pre-tokens come from character classes, their hashes find them in a
table of known pre-tokens (sorted arrays, bounded, kept while the Python worker lives), and only unknown ones
are encoded. Ids equal those of the tokenizers library for the vocabulary files named in the parameters.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

from .common import prefix_hashes, span_hashes

LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4
#: White space of the pattern's \\s, and the letters that may follow an apostrophe in a contraction.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SUFFIXES = ["s", "t", "re", "ve", "m", "ll", "d"]
#: Known pre-tokens kept by a worker, at most.
KNOWN = 400_000
_classes: np.ndarray | None = None


def newer() -> tuple[dict[int, str], list[int]]:
    """Of the code points that Python's Unicode tables lack: those that the library makes lower case, and its letters."""
    from tokenizers import Regex
    from tokenizers.normalizers import Lowercase
    from tokenizers.pre_tokenizers import Split

    unknown = [i for i in range(0x20000) if unicodedata.category(chr(i)) == "Cn"]
    low = Lowercase()
    lower = {i: x for i in unknown if (x := low.normalize_str(chr(i))) != chr(i)}
    other = Split(Regex(r"\p{L}"), "removed").pre_tokenize_str("".join(map(chr, unknown)))
    known = {unknown[k] for _, (start, end) in other for k in range(start, end)}
    return lower, [i for i in unknown if i not in known]


def classes() -> np.ndarray:
    global _classes
    if _classes is None:
        table = np.full(0x110000, OTHER, dtype=np.uint8)
        for i in range(0x110000):
            c = unicodedata.category(chr(i))[0]
            if c == "L":
                table[i] = LETTER
            elif c == "N":
                table[i] = NUMBER
        table[WHITE] = SPACE
        table[newer()[1]] = LETTER
        _classes = table
    return _classes


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points, one after the other, and offsets."""
    offset = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=offset[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), offset


def pretokens(codes: np.ndarray, offset: np.ndarray, join_space: bool, single_numbers: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pre-tokens. join_space: a space before a token belongs to it, white space is kept; else dropped."""
    n = len(codes)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    kind = classes()[codes]
    first = np.zeros(n + 1, dtype=bool)  # a token may begin here
    first[1:n] = kind[1:] != kind[:-1]
    first[offset[offset <= n]] = True
    if single_numbers:
        first[:n] |= kind == NUMBER
    # Contractions: an apostrophe that is a run by itself, with letters after it and no joined space before it.
    quote = np.flatnonzero((codes[:-1] == 39) & first[:-2] & first[1:-1] & (kind[1:] == LETTER)) if n > 1 else np.zeros(0, dtype=np.int64)
    begins_text = np.zeros(n + 1, dtype=bool)
    begins_text[offset[offset <= n]] = True
    quote = quote[~begins_text[quote + 1]]
    if join_space:
        quote = quote[(quote == 0) | begins_text[quote] | (codes[quote - 1] != 32)]
    if len(quote):
        after = np.concatenate([codes, np.zeros(3, dtype=np.uint32)])
        second, third = after[quote + 1], after[quote + 2]
        inside = (quote + 2 < n) & ~begins_text[np.minimum(quote + 2, n)]
        length = np.zeros(len(quote), dtype=np.int64)
        for s in SUFFIXES:
            hit = second == ord(s[0])
            if len(s) == 2:
                hit &= inside & (third == ord(s[1]))
            length[hit & (length == 0)] = len(s)
        quote, length = quote[length > 0], length[length > 0]
        first[quote + 1] = False
        after_it = quote + 1 + length
        first[np.minimum(after_it, n)] = True
    if join_space:
        # The last character of a white-space run before other text stands alone, or joins the text if it is a space.
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~begins_text[1:n])
        first[last] = True
        joined = last[codes[last] == 32]
        first[joined + 1] = False
    start = np.flatnonzero(first[:n])
    end = np.append(start[1:], n)
    if not join_space:
        keep = kind[start] != SPACE
        start, end = start[keep], end[keep]
    return start, end


class Encoder:
    """Base of the two vocabularies: texts to ids in one flat array with offsets."""

    join_space = single_numbers = False
    specials: dict[str, int] = {}

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.hash = np.zeros(0, dtype=np.uint64)
        self.at = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def normalise(self, text: str) -> str:
        return text

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (uint32) and each text's offsets."""
        parts, owner, special = texts, None, None
        if any(s in t for t in texts for s in self.specials):
            split = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")
            parts, owner, special = [], [], []
            for i, t in enumerate(texts):
                for p in split.split(t):
                    parts.append("" if p in self.specials else p)
                    owner.append(i)
                    special.append(self.specials.get(p, -1))
        ids, offset = self._encode([self.normalise(p) for p in parts])
        if owner is None:
            return ids, offset
        out, sizes = [], np.zeros(len(texts), dtype=np.int64)
        for i, (o, s) in enumerate(zip(owner, special, strict=True)):
            piece = ids[offset[i] : offset[i + 1]] if s < 0 else np.array([s], dtype=np.uint32)
            out.append(piece)
            sizes[o] += len(piece)
        return np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)])

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes, offset = code_points(texts)
        start, end = pretokens(codes, offset, self.join_space, self.single_numbers)
        hashes = span_hashes(prefix_hashes(codes), start, end)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.hash, unique)
        known = np.zeros(len(unique), dtype=bool)
        inside = slot < len(self.hash)
        known[inside] = self.hash[slot[inside]] == unique[inside]
        if not known.all():
            if len(self.hash) > KNOWN:
                self.reset()
                known[:] = False
            whole = "".join(texts)
            new = np.flatnonzero(~known)
            found = self.encode_words([whole[start[k] : end[k]] for k in first[new]])
            self._learn(unique[new], found)
            slot = np.searchsorted(self.hash, unique)
        begin, size = self.at[slot], self.at[slot + 1] - self.at[slot]
        count = size[inverse]
        total = np.zeros(len(count) + 1, dtype=np.int64)
        np.cumsum(count, out=total[1:])
        ids = self.ids[np.arange(total[-1]) + np.repeat(begin[inverse] - total[:-1], count)]
        return ids, total[np.searchsorted(start, offset)]

    def _learn(self, hashes: np.ndarray, found: list[list[int]]) -> None:
        sizes = np.concatenate([np.diff(self.at), np.fromiter(map(len, found), dtype=np.int64, count=len(found))])
        ids = np.concatenate([self.ids, np.fromiter((x for f in found for x in f), dtype=np.uint32)])
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        every = np.concatenate([self.hash, hashes])
        order = np.argsort(every, kind="stable")
        self.hash, sizes, begin = every[order], sizes[order], begin[order]
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.ids = ids[np.arange(self.at[-1]) + np.repeat(begin - self.at[:-1], sizes)]


class ByteEncoder(Encoder):
    """The byte-level vocabulary; unknown pre-tokens go to tiktoken with the same ranks and an exhaustive pattern."""

    join_space = True

    def __init__(self, path: str):
        super().__init__()
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.specials = {t["content"]: t["id"] for t in model["added_tokens"]}
        byte = {c: i for i, c in enumerate(byte_alphabet())}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in model["model"]["vocab"].items() if t not in self.specials}
        self.model = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})

    def encode_words(self, words: list[str]) -> list[list[int]]:
        return [self.model.encode_ordinary(w) for w in words]


def byte_alphabet() -> list[str]:
    """The visible character that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class WordEncoder(Encoder):
    """The vocabulary with word ends. Unknown words of a batch are merged together through a pair index."""

    single_numbers = True

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.vocab = model["model"]["vocab"]
        self.end = model["model"]["end_of_word_suffix"]
        self.specials = {t["content"]: t["id"] for t in model["added_tokens"]}
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["model"]["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.bytes = [self.vocab[c] for c in byte_alphabet()]
        self.last = [self.vocab[c + self.end] for c in byte_alphabet()]
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.specials.items()}
        self.lower = newer()[0]
        self.odd = re.compile("[" + "".join(map(chr, self.lower)) + "]") if self.lower else None

    def normalise(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if self.odd and self.odd.search(text):
                text = text.translate(self.lower)
        return text.lower()

    def encode_words(self, words: list[str]) -> list[list[int]]:
        import heapq

        symbols: list[int] = []
        follow: list[int] = []  # position after, -1 at a word's end; a merged position has symbol -1
        before: list[int] = []
        starts = []
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            i, n = len(symbols), len(raw)
            starts.append(i)
            symbols.extend(map(self.bytes.__getitem__, raw[:-1]))
            symbols.append(self.last[raw[-1]])
            follow.extend(range(i + 1, i + n))
            follow.append(-1)
            before.append(-1)
            before.extend(range(i, i + n - 1))
        # The index: rank -> positions where its pair stands or stood; the heap holds the active ranks.
        index: dict[int, list[int]] = {}
        of_rank: dict[int, tuple[int, int, int]] = {}
        active: list[int] = []
        merges = self.merges

        def note(i: int, pair: tuple[int, int]) -> None:
            found = merges.get(pair)
            if found is not None:
                rank = found[0]
                where = index.get(rank)
                if where is None:
                    index[rank] = [i]
                    of_rank[rank] = (*pair, found[1])
                    heapq.heappush(active, rank)
                else:
                    where.append(i)

        for i, j in enumerate(follow):
            if j >= 0:
                note(i, (symbols[i], symbols[j]))
        while active:
            rank = heapq.heappop(active)
            a, b, merged = of_rank.pop(rank)
            where = index.pop(rank)
            where.sort()  # a pair met again in the same word merges from the left
            for i in where:
                if symbols[i] != a or (j := follow[i]) < 0 or symbols[j] != b:
                    continue
                symbols[i], symbols[j] = merged, -1
                after = follow[i] = follow[j]
                if after >= 0:
                    before[after] = i
                    note(i, (merged, symbols[after]))
                if (h := before[i]) >= 0:
                    note(h, (symbols[h], merged))
        out = []
        for i in starts:
            ids = []
            while i >= 0:
                ids.append(symbols[i])
                i = follow[i]
            out.append(ids)
        return out

    def pieces(self) -> list[bytes]:
        """Each id's text in UTF-8 as decode() joins it: vocabulary strings with a space between tokens."""
        size = max(self.token) + 1
        return [self.token.get(i, "").encode() for i in range(size)]
