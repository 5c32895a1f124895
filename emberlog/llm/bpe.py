"""Byte-pair encodings read from the public vocabulary files: splitting, merging and decoding, exact to the library.

A text is first cut at white space (no token crosses from a non-space to a space), so what is kept per worker is the
result for one chunk; texts are never truncated. Caches are bounded and hold results only, never decisions. Which
characters are letters, digits or spaces beyond ASCII, and what they are in lower case, is asked of the library itself:
its Unicode tables are of another age than Python's.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

# Unicode White_Space, which is what \s means to the library's regex engine.
WHITE = r"\t-\r \x85\xa0  -     　"

CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: The words of printable ASCII in lower case; anything else is split by the library.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: The same for the byte-level vocabulary, where a space goes with what follows it.
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: Latin and Cyrillic letters, none of which combines with another; those that the library takes for plain letters are
#: split and lower-cased here.
PLAIN_LETTERS = [*range(0xC0, 0x180), *range(0x400, 0x460)]
CACHE_ENTRIES = 400_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Ids, merges and special strings of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.word_end: str = model.get("end_of_word_suffix") or ""
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        #: left id << 20 | right id -> rank; the rank's own merged id
        self.merge: dict[int, int] = {}
        self.merged: list[int] = []
        self.split: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, both = self.ids[a], self.ids[b], self.ids[a + b]
            self.merge.setdefault(left << 20 | right, rank)
            self.merged.append(both)
            self.split.setdefault(both, (left, right))
        alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        self.token_bytes: dict[int, bytes] = {}
        for token, i in self.ids.items():
            body = token.removesuffix(self.word_end) if self.word_end else token
            self.token_bytes[i] = bytes(map(back.__getitem__, body))
        self.token_bytes |= {i: s.encode() for s, i in self.specials.items()}

    def symbols(self, word: str) -> list[int]:
        """The ids of a word's symbols; the word is in the byte alphabet."""
        return [*map(self.ids.__getitem__, word[:-1]), self.ids[word[-1] + self.word_end]]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def pieces_between_specials(vocab: Vocabulary, text: str) -> list[str]:
    """Odd places hold special strings, even places ordinary text."""
    return vocab.special_split.split(text) if vocab.special_split else [text]


class Cached(dict):
    """Chunk results, computed once; emptied when full so that a worker's memory stays bounded."""

    def __init__(self, compute, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.compute, self.entries = compute, entries

    def __missing__(self, key):
        if len(self) >= self.entries:
            self.clear()
        out = self.compute(key)
        if len(key) <= 64:
            self[key] = out
        return out


class Recent(Cached):
    """As Cached, in two halves: when the newer is full the older goes, so what is asked again and again is never lost."""

    def __init__(self, compute, entries: int = CACHE_ENTRIES):
        super().__init__(compute, entries // 2)
        self.older: dict = {}

    def __missing__(self, key):
        out = self.older.pop(key, None)
        if out is None:
            out = self.compute(key)
        if len(self) >= self.entries:
            self.older = {}  # before the copy, which needs its room
            self.older = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = out
        return out


def library(path: str):
    """The tokenizers library on this file, whole texts and one thread."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


AFTER, BEFORE = [*range(1, 129)], [*range(-1, 127)]


def merged_length(ids: list[int], rank_of: dict[int, int], merged: list[int]) -> int:
    """How many symbols are left after byte-pair merging; ids is used up.

    Symbols form a linked list; a heap holds every adjacent pair that has a merge, keyed by rank and then place (one
    integer). The lowest is popped again and again; a popped pair whose symbols have changed since has another rank by
    now and is skipped. The count is the initial number less one for each merge; the sequence itself is never built.
    """
    n = len(ids)
    get = rank_of.get
    heap = [(r << 32) + i for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
    if not heap:
        return n
    heapify(heap)
    after, before = (AFTER[:n], BEFORE[:n]) if n <= 128 else (list(range(1, n + 1)), list(range(-1, n - 1)))
    ids.append(-1)
    left = n
    while heap:
        top = heappop(heap)
        i = top & 0xFFFFFFFF
        j = after[i]
        if get(ids[i] << 20 | ids[j], -1) != top >> 32:
            continue
        ids[i] = new = merged[top >> 32]
        ids[j] = -1
        k = after[i] = after[j]
        left -= 1
        if k < n:
            before[k] = i
            if (r := get(new << 20 | ids[k])) is not None:
                heappush(heap, (r << 32) + i)
        h = before[i]
        if h >= 0 and (r := get(ids[h] << 20 | new)) is not None:
            heappush(heap, (r << 32) + h)
    return left


class Words:
    """Whole texts by their words, for a vocabulary with word ends. Chunks are what ASCII white space separates; each
    distinct chunk and word is worked on once."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.library = library(path)
        self.normalize, self.split = self.library.normalizer.normalize_str, self.library.pre_tokenizer.pre_tokenize_str
        letters = "".join(filter(self.plain_letter, map(chr, PLAIN_LETTERS)))
        self.plain = re.compile(f"[ -~{letters}]*").fullmatch
        self.plain_words = re.compile(ASCII_WORDS.pattern.replace("a-z", f"a-z{letters}")).findall
        self.alphabet = dict(enumerate(byte_alphabet()))

    def plain_letter(self, c: str) -> bool:
        """Whether the library takes c for a letter as it takes ASCII ones: it stays one word with those around it, and
        its lower case is one character, the same as Python's."""
        low = c.lower()
        if len(low) != 1 or self.normalize(c) != low or self.normalize(f"a{c}b{c}") != f"a{low}b{low}":
            return False
        return all(len(self.split(x)) == 1 for x in (low, c, f"a{low}b", f"{low}{low}a")) and len(self.split(f"{low}1")) == 2

    def words_of(self, chunk: bytes) -> list[str]:
        """In the byte alphabet, where printable ASCII stands for itself."""
        text = chunk.decode()
        if text.isascii() and text.isprintable():
            return ASCII_WORDS.findall(text.lower())
        if self.plain(text):
            return [w if w.isascii() else w.encode().decode("latin-1").translate(self.alphabet) for w in self.plain_words(text.lower())]
        return [word for word, _ in self.split(self.normalize(text))]


class WordCounter(Words):
    """Token counts of whole texts."""

    def __init__(self, path: str):
        super().__init__(path)
        self.words = Cached(lambda word: merged_length(self.vocab.symbols(word), self.vocab.merge, self.vocab.merged), 1_000_000)
        self.counts = Cached(lambda chunk: sum(map(self.words.__getitem__, self.words_of(chunk))))

    def count(self, text: str) -> int:
        if "<|" not in text:
            return sum(map(self.counts.__getitem__, text.encode().split()))
        parts = pieces_between_specials(self.vocab, text)
        return len(parts) // 2 + sum(sum(map(self.counts.__getitem__, p.encode().split())) for p in parts[::2])


class WordEncoder(Words):
    """Ids of whole texts, little-endian unsigned 32-bit; the library's model turns each distinct word into ids."""

    def __init__(self, path: str):
        super().__init__(path)
        model = self.library.model.tokenize
        self.words = Recent(lambda word: array("I", [t.id for t in model(word)]).tobytes(), CACHE_ENTRIES * 3 // 4)
        self.chunks = Recent(lambda chunk: b"".join(map(self.words.__getitem__, self.words_of(chunk))), CACHE_ENTRIES * 3 // 2)

    def encode(self, text: str) -> bytes:
        chunks = self.chunks.__getitem__
        if "<|" not in text:
            return b"".join(map(chunks, text.encode().split()))
        specials = self.vocab.specials
        return b"".join(specials[p].to_bytes(4, "little") if k % 2 else b"".join(map(chunks, p.encode().split())) for k, p in enumerate(pieces_between_specials(self.vocab, text)))


class PrefixEncoder:
    """Byte-level encoding by dynamic programming over prefixes.

    For every prefix of a chunk exactly one token can be the last of its encoding. An automaton over the vocabulary
    gives the tokens that end at each byte; the last token is the one that starts where a prefix ends whose own last
    token is compatible with it. Following the stored tokens back from the end gives the ids.
    """

    def __init__(self, path: str):
        import ahocorasick

        self.vocab = vocab = vocabulary(path)
        self.rank = {both: r for r, both in reversed([*enumerate(vocab.merged)])}
        self.fits = Cached(lambda pair: self.compatible(pair[0], pair[1], len(vocab.merged)), 1_000_000)
        self.automaton = ahocorasick.Automaton()
        for token, body in vocab.token_bytes.items():
            if token in vocab.split:
                a, b = vocab.split[token]
                if not self.compatible(a, b, self.rank[token]):
                    continue  # merging its own bytes never gives it
            elif token in vocab.specials.values():
                continue
            self.automaton.add_word(body.decode("latin-1"), (token, len(body)))
        self.automaton.make_automaton()
        self.bodies = [vocab.token_bytes.get(i, b"") for i in range(max(vocab.token_bytes) + 1)]
        self.words = Cached(self.encode_word)
        self.split = library(path).pre_tokenizer.pre_tokenize_str
        self.chunks = Cached(lambda chunk: b"".join(map(self.words.__getitem__, self.words_of(chunk))))

    def words_of(self, chunk: str) -> list[str]:
        return ASCII_PIECES.findall(chunk) if chunk.isascii() else [chunk[a:b] for _, (a, b) in self.split(chunk)]

    def compatible(self, left: int, right: int, limit: int) -> bool:
        """Whether two adjacent tokens stay apart: no pair that ever meets at the seam merges before it is used up.

        Goes back in time from the end. limit is the rank of the merge that ends the present pair at the seam (a seam
        pair of lower rank would have come first). Of equal ranks the left one comes first.
        """
        rank, split, merge = self.rank.get, self.vocab.split, self.vocab.merge.get
        while True:
            if merge(left << 20 | right, limit) < limit:
                return False
            a, b = rank(left, -1), rank(right, -1)
            if a < 0 and b < 0:
                return True
            if b >= a:
                right, limit = split[right][0], b + 1
            else:
                left, limit = split[left][1], a

    def encode_word(self, word: str) -> bytes:
        raw = word.encode().decode("latin-1")
        last: list[tuple[int, int]] = [(-1, 0)] * (len(raw) + 1)
        fits = self.fits
        done = 0
        for end, (token, size) in self.automaton.iter(raw):
            if end < done:
                continue  # the only last token of this prefix is known
            start = end + 1 - size
            if start == 0 or fits[last[start][0], token]:
                last[end + 1] = (token, start)
                done = end + 1
        ids = []
        at = len(raw)
        while at:
            token, at = last[at]
            ids.append(token)
        ids.reverse()
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        chunks = self.chunks.__getitem__
        if "<|" not in text:
            return b"".join(map(chunks, CHUNK.findall(text)))
        specials = self.vocab.specials
        return b"".join(specials[p].to_bytes(4, "little") if k % 2 else b"".join(map(chunks, CHUNK.findall(p))) for k, p in enumerate(pieces_between_specials(self.vocab, text)))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bodies.__getitem__, array("I", ids))).decode("utf-8", "replace")
