"""Token ids of whole texts by a file of the tokenizers library, with a cache of chunks.

A chunk is a run without ASCII white space, cut again before a comma or full stop that follows
an ASCII letter or digit, or an accented one of Latin-1. It holds for tokenizers that lower-case, and whose result on a text is
the concatenation of their results on its chunks, as with files that drop white space, never
join letters or digits with punctuation, and whose normaliser doesn't reach across these borders.
Special tokens' strings in a text are the special tokens, as by the library's default, or else
(``special`` is false) ordinary text.

Words of small letters up to Latin-1, most of what is new in a text, are given to the model as it would get them: neither the
normaliser nor the pattern changes them. Marks at a word's end are learnt apart from it.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np

CACHE_ENTRIES = 400_000

_CODERS: dict[tuple[str, str, bool], ChunkTokenizer] = {}
_MARK = re.compile(rb"(?<=[a-z0-9])[.,]|(?<=\xc3[\xa0-\xb6\xb8-\xbf])[.,]")  # after a to z, 0 to 9, \u00e0 to \u00ff
#: Words that come through the normaliser and the pattern as they are, and such words with ASCII marks behind; an apostrophe may begin a suffix.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+")
_MARKED = re.compile(rb"((?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]+)")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Kinds of bytes: q, a comma or full stop; p, other ASCII marks; m, the start of a letter beyond Latin-1.
_KINDS = bytes(
    ord("q") if chr(b) in ".,"
    else ord("m") if b in (0xC2, *range(0xC4, 0x100))
    else ord("p") if b < 0x80 and not chr(b).isalnum() and b not in b" \t\n\r\x0b\x0c"
    else ord("x")
    for b in range(256)
)


def chunks(text: bytes) -> list[bytes]:
    """The chunks of a text in UTF-8, A to Z lower-cased."""
    low = text.lower()
    kinds = low.translate(_KINDS)
    odd = b"m" in kinds or b"pq" in kinds or b"qq" in kinds or b"\xc3\x97" in low or b"\xc3\xb7" in low
    if odd:
        return _MARK.sub(rb" \g<0>", low).split()
    return low.replace(b",", b" ,").replace(b".", b" .").split()


def _direct(library):
    """A tokenizer with the library's model that takes words _LETTERS by white space, if the library's does nothing else with them."""
    from tokenizers import Tokenizer, pre_tokenizers

    def steps(part, kind: str) -> list[dict]:
        state = json.loads(part.__getstate__()) if part is not None else {"type": "Sequence", kind: []}
        return state[kind] if state["type"] == "Sequence" else [state]

    replaced = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    if any(x != replaced and x["type"] not in ("NFC", "Lowercase") for x in steps(library.normalizer, "normalizers")):
        return None
    cut = steps(library.pre_tokenizer, "pretokenizers")
    if [x["type"] for x in cut] != ["Split", "ByteLevel"] or library.post_processor is not None or library.model.dropout:
        return None
    if (cut[0]["pattern"], cut[0]["behavior"], cut[0]["invert"]) != ({"Regex": _PATTERN}, "Removed", True) or cut[1]["add_prefix_space"] or cut[1]["use_regex"]:
        return None
    out = Tokenizer(library.model)
    out.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    return out


class ChunkTokenizer:
    """Ids as packed little-endian integers: format ``I`` (32 bits) or ``H`` (16 bits)."""

    def __init__(self, path: str, kind: str, special: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # whole texts are cut at them here
        added = {t.content.encode(): i for i, t in self.library.get_added_tokens_decoder().items()} if special else {}
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, sorted(added, key=len, reverse=True))) + b")") if added else None
        #: Their chunks begin with a space, as no chunk of a text does.
        self.special = {b" " + t: i for t, i in added.items()}
        self.kind = kind
        self.dtype = np.dtype({'I': '<u4', 'H': '<u2'}[kind])
        self.direct = _direct(self.library)
        suffix = self.library.model.end_of_word_suffix or "\0"  # without one, chunks are encoded one by one
        vocabulary = self.library.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.chunks: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.kind}", *ids)

    def _learn(self, unseen: set[bytes]) -> bool:
        """Adds chunks to the cache, which keeps what its last two generations have used; or begins a generation."""
        if len(self.chunks) + len(unseen) > CACHE_ENTRIES:
            self.old, self.chunks = self.chunks, {}
            return False
        new = self._not_kept(unseen)
        special = new & self.special.keys()
        self.chunks.update((w, self._pack([self.special[w]])) for w in special)
        new -= special
        letters = [w for w in new if w.isalpha() or _LETTERS.fullmatch(w)] if self.direct else []
        other = new.difference(letters)
        marked = [m for m in map(_MARKED.fullmatch, other) if m] if self.direct else []
        if marked:
            parts = self._not_kept({x for m in marked for x in m.groups()}.difference(letters) - self.chunks.keys())
            other = other.difference([m[0] for m in marked]) | parts
            more = [w for w in parts if _LETTERS.fullmatch(w)]
            other.difference_update(more)
            letters += more
        texts = [(w, w.decode()) for w in other]
        self.chunks.update((w, self._encoded(w)) for w, x in texts if not x.isalpha())
        # a chunk of letters is one pre-token: all of them at once, told apart by the ids that end one
        plain = [w for w, x in texts if x.isalpha()]
        self._add(plain, b" ".join(plain).decode(), self.library)
        # the two bytes of such words that other characters than they themselves stand for
        self._add(letters, b" ".join(letters).decode("latin-1").replace("\xa0", "\u0142").replace("\xad", "\u0143"), self.direct)
        get = self.chunks.__getitem__
        self.chunks.update([(m[0], get(m[1]) + get(m[2])) for m in marked])
        return True

    def _not_kept(self, words: set[bytes]) -> set[bytes]:
        """The words that the last generation doesn't have either."""
        known = words & self.old.keys()
        self.chunks.update((w, self.old[w]) for w in known)
        return words - known

    def _encoded(self, word: bytes) -> bytes:
        return self._pack(self.library.encode(word.decode(), add_special_tokens=False).ids)

    def _add(self, words: list[bytes], text: str, library) -> None:
        """Adds chunks that are one pre-token each; text: all of them, for ``library``."""
        if not words:
            return
        ids = np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(self.final[ids]) + 1
        if len(ends) == len(words):
            packed = ids.tobytes()
            ends = (ends * self.dtype.itemsize).tolist()
            self.chunks.update(zip(words, [packed[i:j] for i, j in zip([0, *ends], ends)]))
        else:  # it divides some of them
            self.chunks.update((w, self._encoded(w)) for w in words)

    def split(self, text: bytes) -> list[bytes]:
        if self.cut is None or not self.cut.search(text):
            return chunks(text)
        parts = self.cut.split(text)  # special tokens are at odd places
        return [w for i, x in enumerate(parts) for w in ([b" " + x] if i % 2 else chunks(x))]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Packed ids of texts in UTF-8; none for a null or empty one."""
        split = [self.split(x) if x else [] for x in texts]
        distinct = set().union(*split)
        if len(distinct) <= CACHE_ENTRIES:
            return self._encode(split, distinct)
        step = CACHE_ENTRIES  # more than the cache holds: piece by piece, each of which fits
        return [
            b"".join(self._encode([piece], set(piece))[0] for piece in (words[i : i + step] for i in range(0, len(words), step)))
            for words in split
        ]

    def _encode(self, split: list[list[bytes]], distinct: set[bytes]) -> list[bytes]:
        """Packed ids of lists of chunks, of which at most CACHE_ENTRIES are distinct."""
        unseen = distinct.difference(self.chunks)
        if unseen and not self._learn(unseen) and not unseen <= self.chunks.keys():
            self._learn(distinct)  # the generation has just changed
        get = self.chunks.__getitem__
        return [b"".join(map(get, words)) for words in split]


def tokenizer(path: str, kind: str = "I", special: bool = True) -> ChunkTokenizer:
    """One tokenizer a worker process."""
    if (path, kind, special) not in _CODERS:
        _CODERS[path, kind, special] = ChunkTokenizer(path, kind, special)
    return _CODERS[path, kind, special]


def forget() -> None:
    """Gives up this process's tokenizers and what they have cached: workers outlive their tasks and stages."""
    _CODERS.clear()
