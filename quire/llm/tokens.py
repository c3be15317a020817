"""Token ids of whole texts, through the tokenizers library with a bounded memory of pieces.

Both tokenizers cut a text at certain white space before any merge, so the ids of a text are the ids of
its pieces joined. A worker remembers the ids of the pieces it has met and encodes only new ones;
the result is that of encoding the whole text. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quire.llm.common import held

#: Pieces that a worker remembers before it keeps only those of its last batch (about 200 bytes each), the
#: longest remembered, and the texts whose pieces are found together.
MEMORY, LONGEST, TEXTS = 350_000, 64, 4096
#: A single space or line feed between two characters that are no white space: there, byte-level BPE cuts.
_SPACE, _LINE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"(?<=\S)\n(?=\S)")
_PLAIN = re.compile(r"\s\s")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """Encodes texts to bytes of little-endian ids, `dtype` wide."""

    def __init__(self, path: str, words: bool, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.words, self.memory = words, memory
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        #: Ids that end a word, or that begin with a space.
        self.marks = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.marks[i] = token.endswith("</w>") if words else token.startswith("\u0120")
        self.line_id = self.tokenizer.token_to_id("\u010a")
        self.known: dict = {}

    def _split(self, text: str) -> list:
        """Pieces whose ids, joined, are those of the text."""
        if self.words:  # all white space is dropped, and no token spans it; case is dropped too
            return text.encode("utf-8", "surrogatepass").lower().split()
        plain = text.strip() == text and not _PLAIN.search(text)
        out: list = []
        for i, line in enumerate(text.split("\n") if plain else _LINE.split(text)):
            if i:
                out.append("\n")
            first, *rest = line.split(" ") if plain else _SPACE.split(line)
            if first:
                out.append(first)
            if rest:
                out.extend([" " + x for x in rest])
        return out

    def _encode(self, pieces: list) -> list[bytes]:
        """Ids of each piece. Pieces of one kind are encoded as one text, in which the ids tell where each begins."""
        texts = [p.decode("utf-8", "replace") for p in pieces] if self.words else pieces
        out: list = [b""] * len(pieces)
        if self.words:
            kinds = [" " if t.isalpha() else "" for t in texts]
        else:
            kinds = [" " if t[:1] == " " and len(t) > 1 else "\n" if t and t != "\n" else "" for t in texts]
        for kind in (" ", "\n", ""):
            some = [i for i, k in enumerate(kinds) if k == kind]
            if some:
                for i, ids in zip(some, self._together([texts[i] for i in some], kind), strict=True):
                    out[i] = ids
        return out

    def _together(self, texts: list[str], kind: str) -> list[bytes]:
        joined = (" " if self.words else "" if kind == " " else "\n").join(texts)
        if kind and len(joined.split()) == len(texts) and joined.count("\n") == (len(texts) - 1) * (kind == "\n"):
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.dtype)
            raw, width = ids.tobytes(), self.dtype.itemsize
            if kind == "\n":  # each line feed is an id of its own, which belongs to no piece
                cuts = np.flatnonzero(ids == self.line_id)
                if len(cuts) == len(texts) - 1:
                    return [raw[a:b] for a, b in zip([0, *((cuts + 1) * width).tolist()], [*(cuts * width).tolist(), len(raw)], strict=True)]
            else:  # an id with a space begins a piece; with word ends, such an id ends it
                cuts = np.flatnonzero(self.marks[ids]) + self.words
                if len(cuts) == len(texts):
                    bounds = [0, *(cuts * width).tolist()] if self.words else [*(cuts * width).tolist(), len(raw)]
                    return [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _stem(self, piece):
        """The piece without a last comma or full stop after a plain letter, where both tokenizers cut; else None."""
        if len(piece) > 2 and piece[-1:] in ((b",", b".") if self.words else (",", ".")):
            if (chr(piece[-2]) if self.words else piece[-2]) in LETTERS:
                return piece[:-1]
        return None

    def _learn(self, new: list) -> dict:
        """Ids of pieces that aren't known; those worth it are remembered."""
        known, got, ended = self.known, {}, []
        todo: dict = {}
        ends = (44, 46) if self.words else (",", ".")
        for p in new:
            if not p or p[-1] not in ends or (stem := self._stem(p)) is None:
                todo[p] = None
                continue
            last = p[-1:]
            ended.append((p, stem, last))
            if stem not in known:
                todo[stem] = None
            if last not in known:
                todo[last] = None
        names = list(todo)
        for at in range(0, len(names), 20_000):
            got.update(zip(names[at : at + 20_000], self._encode(names[at : at + 20_000]), strict=True))
        for p, stem, last in ended:
            got[p] = (got.get(stem) or known.get(stem) or b"") + (got.get(last) or known[last])
        return got

    def encode(self, texts: Iterable[str | None], at_once: int = TEXTS) -> list[bytes]:
        """Ids of each text (null: none)."""
        texts, out = [t or "" for t in texts], []
        for at in range(0, len(texts), at_once):
            some = texts[at : at + at_once]
            plain = [self.words or self._plain(t) for t in some]
            fast = iter(self._encode_plain([t for t, ok in zip(some, plain, strict=True) if ok]))
            slow = iter(self._encode_split([t for t, ok in zip(some, plain, strict=True) if not ok]))
            out.extend(next(fast) if ok else next(slow) for ok in plain)
        return out

    def _encode_split(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        split = [self._split(t) for t in texts]
        pieces = list(set().union(*split))
        found = dict(zip(pieces, self._ids(pieces), strict=True))
        return [b"".join([found[p] for p in x]) for x in split]

    def _ids(self, pieces: list) -> list[bytes]:
        """Ids of distinct pieces, from memory or learned; a memory that is full keeps only these."""
        known = self.known
        new = [p for p in pieces if p not in known]
        if new and len(known) + len(new) > self.memory:
            self.known = known = {p: known[p] for p in pieces if p in known}
        got = self._learn(new)
        known.update(got)
        found = list(map(known.__getitem__, pieces))
        for p in [p for p in got if len(p) > LONGEST]:
            del known[p]
        return found

    @staticmethod
    def _plain(text: str) -> bool:
        """No white space at the ends or next to white space, and no NUL, which marks a line's first piece below."""
        return text.strip() == text and not _PLAIN.search(text) and "\0" not in text

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """Texts are cut and their distinct pieces found by Arrow; ids are then laid out by numpy."""
        if not texts:
            return []
        if self.words:
            lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
        else:
            lists = pc.split_pattern(pa.array(["\0" + t.replace("\n", " \n \0") for t in texts], pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        if self.words:
            names = [x.encode("utf-8", "surrogatepass") for x in names]
        else:
            names = [x[1:] if x[:1] == "\0" else x if x == "\n" else " " + x for x in names]
        ids = self._ids(names)
        flat = np.frombuffer(b"".join(ids), self.dtype)
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // self.dtype.itemsize
        first = np.cumsum(sizes, dtype=np.int32) - sizes
        at = coded.indices.to_numpy()
        each = sizes[at]
        ends = np.cumsum(each, dtype=np.int32)  # a batch of texts has less than 2^31 ids
        total = int(ends[-1]) if len(ends) else 0
        from_ = np.repeat(first[at] - ends + each, each)
        from_ += np.arange(total, dtype=np.int32)
        stream = flat[from_].tobytes()
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy()] * self.dtype.itemsize
        return [stream[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


#: Letters after which a comma or full stop begins a new piece in either tokenizer.
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def pieces(path: str, words: bool, memory: int = MEMORY) -> Pieces:
    """The worker's encoder of a tokenizer file; loaded once a process."""
    return held(f"tokens {path} {words} {memory}", lambda: Pieces(path, words, memory))
