"""Token ids of a public tokenizer, fast enough for whole corpora."""

from __future__ import annotations

import os
from array import array
from itertools import chain

import numpy as np

#: pieces whose ids a worker keeps; beyond it the table is begun anew
CACHE = 1_200_000
#: characters from which on a piece counts as long; these are hardly met again, and take
#: room for at most `CACHE` characters
LONGEST = 60
_FIRST = "\0"  # not printable, so in no piece
_MARKS = ".,|!;:?"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _blank_pieces(text: str) -> list[str] | None:
    """What lies between the blanks, newlines kept as first characters; None if the
    text has white space of another kind or in runs."""
    if not text.replace("\n", "").isprintable():
        return None
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[-1:] in " \n":
        return None
    return text.replace("\n", " \n").split(" ")


def _word_pieces(text: str) -> list[str] | None:
    """Words in lower case, after an empty first piece; None if lower case depends on
    context or makes marks, or white space may be of another kind."""
    if not text.replace("\n", "").isprintable() or "\u0130" in text or "\u03a3" in text:
        return None
    return ["", *text.lower().split()]


class Grown:
    """Numbers that are appended to, in room that doubles."""

    def __init__(self, dtype):
        self.room, self.n = np.empty(1 << 16, dtype=dtype), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            self.room = np.concatenate([self.all(), np.empty(max(len(self.room), len(values)), dtype=self.room.dtype)])
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)

    def all(self) -> np.ndarray:
        return self.room[: self.n]


class _Pieces(dict):
    """Number of each piece met."""

    def __init__(self):
        super().__init__()
        self.names: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self.names)
        self.names.append(piece)
        return number


class Encoder:
    """ids as little-endian unsigned 32-bit bytes, just as the tokenizer gives them.

    A byte-level pre-tokenizer always ends a token where a blank or newline follows
    another character, and where a mark follows a letter or digit; a word tokenizer
    (`lower`: one that drops white space and case) also between words. So texts are
    cut there and each piece's ids kept, all in one array from which a slice of texts is
    gathered: the result is that of the whole text. Texts that hold an added token's
    text, in any case, go to the tokenizer whole. Only valid for tokenizers of those two
    kinds.
    """

    def __init__(self, path: str, lower: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # a word of Latin letters is one token before merging, so nothing needs to split it
        self.merger = Tokenizer.from_file(path)
        self.merger.normalizer = normalizers.Sequence([])
        self.merger.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.split = _word_pieces if lower else _blank_pieces
        self.lead = "" if lower else " "
        self.marks: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        self.pieces = _Pieces()
        self.long = 0  # characters of long pieces
        self.flat, self.starts, self.sizes = Grown("<u4"), Grown(np.int64), Grown(np.int64)

    def _cut(self, text: str) -> list[str] | None:
        if any(a in text.lower() for a in self.added) if "<" in text else False:
            return None
        return self.split(text)

    def _ids(self, texts: list[str], tokenizer=None) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 300):
            found = (tokenizer or self.tokenizer).encode_batch_fast(texts[at : at + 300], add_special_tokens=False)
            out += [array("I", e.ids).tobytes() for e in found]
        return out

    def _spell(self) -> None:
        """Ids of pieces met since the last call; a run of marks at the end counts by itself."""
        names, known = self.pieces.names, self.sizes.n
        marked, words, rest, i = [], [], [], known
        while i < len(names):  # stems of marked pieces join the end
            p = names[i]
            if len(p) > LONGEST:
                self.long += len(p)
            if p.isalpha():
                (words if p.isascii() or max(p) < "\u0250" else rest).append(i)
            else:
                s = p.rstrip(_MARKS)
                if len(s) < len(p) and s.isalnum():
                    marked.append((i, self.pieces[s], p[len(s) :]))
                else:
                    rest.append(i)
            i += 1
        data = [b""] * (len(names) - known)
        for at, ids in zip(words, self._ids([self.lead + names[i] for i in words], self.merger)):
            data[at - known] = ids
        # a text's first piece is marked by a zero, others follow a blank or begin with a newline
        plain = [p[1:] if p[:1] == _FIRST else p if p[:1] == "\n" else self.lead + p for p in (names[i] for i in rest)]
        for at, ids in zip(rest, self._ids(plain)):
            data[at - known] = ids
        earlier = self.flat.all().tobytes() if any(stem < known for _, stem, _ in marked) else b""
        for at, stem, m in marked:
            if m not in self.marks:
                if len(self.marks) > 10_000:
                    self.marks.clear()
                self.marks[m] = self._ids([m])[0]
            if stem < known:
                begin = 4 * self.starts.room[stem]
                own = earlier[begin : begin + 4 * self.sizes.room[stem]]
            else:
                own = data[stem - known]
            data[at - known] = own + self.marks[m]
        size = np.fromiter(map(len, data), dtype=np.int64, count=len(data)) // 4
        self.starts.extend(self.flat.n + np.cumsum(size) - size)
        self.sizes.extend(size)
        self.flat.extend(np.frombuffer(b"".join(data), dtype="<u4"))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        if len(self.pieces) > CACHE or self.long > CACHE:
            self._forget()
        cut = [self._cut(t) for t in texts]
        for ps in cut:
            if ps:
                ps[0] = _FIRST + ps[0]
        whole = iter(self._ids([t for t, ps in zip(texts, cut) if ps is None]))
        numbers = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(ps or () for ps in cut)), dtype=np.int64)
        self._spell()
        size, start = self.sizes.all()[numbers], self.starts.all()[numbers]
        after = np.cumsum(size)
        at = np.arange(after[-1] if len(after) else 0) + np.repeat(start - (after - size), size)
        data = self.flat.all()[at].tobytes()
        ends = np.append(0, 4 * after)[np.cumsum([len(ps or ()) for ps in cut])].tolist()
        return [next(whole) if ps is None else data[a:b] for ps, a, b in zip(cut, [0, *ends[:-1]], ends)]


_open: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, lower: bool) -> Encoder:
    """One per worker process and vocabulary, so that tasks share what it knows."""
    if (path, lower) not in _open:
        _open.clear()
        _open[path, lower] = Encoder(path, lower)
    return _open[path, lower]
