"""Token ids of a lower-casing byte-level BPE tokenizer with word ends, for whole batches of texts.

The ids are those of the ``tokenizers`` library, which takes several times as long on texts with many different
words. Texts are split by classes of code points, equal words are found by their hashes, and only different words are
merged, all at once: in each round every word merges its pair of lowest rank, until no word has one. Texts that the
rules here do not cover go to the library itself: those with its special tokens, those that change by normalisation
before or after lower case, those with a letter whose lower case depends on its neighbours, and very long words.
"""

from __future__ import annotations

import json
import os
import sys
import unicodedata

import numpy as np

from matricula.llm.base import mix, per_worker

#: Words of more bytes are merged by the library.
LONG = 64
# Classes of code points. S: white space, L: letter, N: number, P: any other.
S, L, N, P = range(4)
NONE = np.iinfo(np.int32).max
#: The definition that the rules here state: normaliser and splitter of the word tokenizer (fixed values).
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def checked(definition: str) -> str:
    """The definition, if it is one that the rules here state."""
    d = json.loads(definition)
    m = d["model"]
    same = d["normalizer"] == NORMALIZER and d["pre_tokenizer"] == SPLIT and not d["post_processor"] and m["type"] == "BPE"
    plain = not (m["dropout"] or m["unk_token"] or m["continuing_subword_prefix"] or m["byte_fallback"] or m["ignore_merges"])
    if not same or not plain or not m["end_of_word_suffix"]:
        raise ValueError("not a lower-casing byte-level tokenizer with word ends")
    return definition


def byte_letters() -> list[str]:
    """The letter for which byte-level vocabularies write each byte: printable Latin-1 bytes are themselves, the others follow from U+0100."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in own]
    table = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


def code_classes() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, P, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k in "LN":
            table[c] = L if k == "L" else N
    # Unicode property White_Space (fixed values).
    table[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = S
    return table


def word_ranges(points: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end code point of each match of the split pattern, over texts with white space after each."""
    cls = table[points]
    before = np.r_[np.uint8(S), cls[:-1]]
    start = ((cls == L) & (before != L)) | (cls == N) | ((cls == P) & (before != P))
    mark = np.flatnonzero((points == 0x27) & (before != P))
    mark = mark[mark + 2 < len(points)]
    one, two = points[mark + 1], points[mark + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long_ = np.zeros(len(mark), bool)
    for a, b in ("re", "ve", "ll"):
        long_ |= (one == ord(a)) & (two == ord(b))
    # A contraction takes its letters; a letter behind it starts anew.
    start[mark[short | long_] + 1] = False
    after = np.r_[mark[short] + 2, mark[long_] + 3]
    after = after[after < len(points)]
    start[after] |= cls[after] == L
    edge = np.flatnonzero(start | (cls == S))
    first = start[edge]
    return edge[first], np.r_[edge[1:], len(points)][first]


SLOT_BITS = 17


def _slot(key: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def equal_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of at most ``LONG`` bytes: one word of each set of equal ones, and the number of each word's set. Words are hashed and
    then compared, eight bytes at a time."""
    wide = np.ndarray(len(data), "<u8", np.r_[data, np.zeros(8, np.uint8)].tobytes(), strides=(1,))  # the eight bytes from each byte on
    size = end - start
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    steps = []  # (words with more than 8 k bytes, the bytes from there on)
    for k in range(0, int(size.max(initial=0)), 8):
        at = np.flatnonzero(size > k)
        steps.append((at, wide[start[at] + k] & mask[np.minimum(size[at] - k, 8)]))
    hashed = size.astype(np.uint64)
    for at, x in steps:
        hashed[at] = mix(hashed[at] * np.uint64(0x9E3779B97F4A7C15) + x)
    _, one, which = np.unique(hashed, return_index=True, return_inverse=True)
    differ = size != size[one][which]
    for at, x in steps:
        full = np.zeros(len(size), np.uint64)
        full[at] = x
        differ |= full != full[one][which]
    if differ.any():  # two words under one hash: these stand for themselves
        alone = np.flatnonzero(differ)
        which[alone] = len(one) + np.arange(len(alone))
        one = np.r_[one, alone]
    return one, which


class WordBpe:
    """Encoder of one tokenizer definition."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_str(definition)
        d = json.loads(definition)
        m, vocabulary = d["model"], d["model"]["vocab"]
        self.special = [x["content"] for x in d["added_tokens"]]
        letters, end = byte_letters(), m["end_of_word_suffix"]
        self.inner = np.array([vocabulary[c] for c in letters], np.int64)
        self.last = np.array([vocabulary[c + end] for c in letters], np.int64)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in m["merges"]]
        self.shift = max(vocabulary.values()).bit_length()
        keys = np.array([vocabulary[a] << self.shift | vocabulary[b] for a, b in pairs], np.int64)
        self.new = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        # Ranks of pairs by a hash: the pairs of one slot lie in one table after the other.
        self.slots = []
        left = np.arange(len(keys))  # the place in the list is the rank
        while len(left):
            key, rank = np.full(1 << SLOT_BITS, -1, np.int64), np.full(1 << SLOT_BITS, NONE, np.int32)
            slot, first = np.unique(_slot(keys[left]), return_index=True)
            key[slot], rank[slot] = keys[left[first]], left[first]
            self.slots.append((key, rank))
            left = np.delete(left, first)
        # Ranks of the pairs that words begin with: two bytes, the second perhaps the last one.
        ends = np.r_[self.inner, self.last]
        self.first = self.ranks(np.repeat(self.inner, 512), np.tile(ends, 256)).reshape(256, 512)
        self.table = code_classes()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; ``NONE`` if it has none."""
        key = left << self.shift | right
        slot = _slot(key)
        out = np.full(len(key), NONE, np.int32)
        todo = np.arange(len(key))
        for keys, ranks in self.slots:
            there = keys[slot]
            hit = there == key
            out[todo[hit]] = ranks[slot[hit]]
            more = ~hit & (there >= 0)
            if not more.any():
                break
            todo, slot, key = todo[more], slot[more], key[more]
        return out

    def merged(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at the byte ranges, one after the other, and their number for each word."""
        size = end - start
        word = np.repeat(np.arange(len(size)), size)
        first = np.cumsum(size) - size
        byte = data[np.arange(len(word)) - np.repeat(first - start, size)].astype(np.int64)
        symbols = self.inner[byte]
        symbols[first + size - 1] = self.last[data[end - 1]]
        rank = np.full(len(word), NONE, np.int32)
        final = np.zeros(len(word), np.int64)
        final[first + size - 1] = 256
        rank[:-1] = self.first[byte[:-1], (byte + final)[1:]]
        rank[first + size - 1] = NONE  # no pair across words
        done_words, done_symbols = [], []
        while len(word):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, first)
            count = np.diff(np.r_[first, len(word)])
            open_ = least != NONE
            if not open_.all():
                stay = np.repeat(open_, count)
                done_words.append(word[~stay])
                done_symbols.append(symbols[~stay])
                word, symbols, rank = word[stay], symbols[stay], rank[stay]
                least, count = least[open_], count[open_]
                if not len(word):
                    break
            at = np.flatnonzero(rank == np.repeat(least, count))
            at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]]  # the leftmost of each word
            symbols[at] = self.new[least]
            gone = np.ones(len(word), bool)
            gone[at + 1] = False
            word, symbols, rank = word[gone], symbols[gone], rank[gone]
            at = at - np.arange(len(at))  # places after the removals
            last = np.r_[word[1:] != word[:-1], True]
            has_next, has_prev = ~last[at], (at > 0) & ~np.r_[True, last[:-1]][at]
            rank[at] = NONE
            x = at[has_next]
            rank[x] = self.ranks(symbols[x], symbols[x + 1])
            x = at[has_prev] - 1
            rank[x] = self.ranks(symbols[x], symbols[x + 1])
        if not done_words:
            return np.zeros(0, np.int64), np.zeros(len(size), np.int64)
        words, out = np.concatenate(done_words), np.concatenate(done_symbols)
        order = np.argsort(words, kind="stable")
        return out[order], np.bincount(words, minlength=len(size))

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def covered(self, text: str, lower: str) -> bool:
        if any(x in text for x in self.special):
            return False
        if text.isascii():
            return True
        nfc = unicodedata.is_normalized
        return "Σ" not in text and nfc("NFC", text) and nfc("NFC", lower)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        lower = [x.lower() for x in texts]
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        own = [i for i, x in enumerate(texts) if self.covered(x, lower[i])]
        rest = sorted(set(range(len(texts))).difference(own))
        for i, ids in zip(rest, self._library([texts[i] for i in rest]), strict=True):
            out[i] = ids
        joined = "".join(lower[i] + "\n" for i in own)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        first, end = word_ranges(points, self.table) if len(points) else (np.zeros(0, np.int64),) * 2
        if not len(first):
            return out
        row = np.searchsorted(np.cumsum([len(lower[i]) + 1 for i in own]), first, "right")
        if joined.isascii():
            a, b = first, end
        else:
            width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000).astype(np.int64)
            byte = np.r_[0, np.cumsum(width)]
            a, b = byte[first], byte[end]
        data = np.frombuffer(joined.encode("utf-8"), np.uint8)
        short = np.flatnonzero(b - a <= LONG)
        one, of_short = equal_words(data, a[short], b[short])
        ids, number = self.merged(data, a[short][one], b[short][one])
        long_ = np.flatnonzero(b - a > LONG)
        more = self._library([data[a[i] : b[i]].tobytes().decode("utf-8") for i in long_.tolist()])
        count = np.r_[number, np.array([len(x) for x in more], np.int64)]
        place = np.cumsum(count) - count
        which = np.zeros(len(a), np.int64)
        which[short], which[long_] = of_short, len(one) + np.arange(len(long_))
        ids = np.concatenate([ids.astype("<u4"), *more])
        n, begin = count[which], place[which]
        flat = ids[np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)]
        cut = np.r_[0, np.cumsum(np.bincount(row, weights=n, minlength=len(own)).astype(np.int64))]
        for k, i in enumerate(own):
            out[i] = flat[cut[k] : cut[k + 1]]
        return out


def encoder(definition: str) -> WordBpe:
    """The worker's encoder of this definition."""
    return per_worker(f"word_bpe_{hash(definition)}", lambda: WordBpe(definition))
