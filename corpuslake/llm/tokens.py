"""Token ids of whole texts, by the tokenizers library, with a cache of words.

The byte-level tokenizer first cuts a text before every single blank or line end between visible characters, and
between a letter and the punctuation behind it, and encodes the pieces on their own.  Cutting there ourselves lets
each distinct piece be encoded once per worker; a text with white space of any other form is encoded whole.
New pieces are encoded in joined runs and cut again where an id begins with the blank or line end that led a piece.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

_OTHER_SPACE = re.compile(r"\s\s|[^\S \n]")
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
#: Pieces kept per worker, about 250 bytes each; an older half is dropped when a younger one is full, and at a task's end.
_CACHE_LIMIT = 1_000_000
#: Pieces of one joined run, and of one call.
_RUN, _TURN = 100, 20_000


class Encoder:
    """Ids as little-endian 32-bit bytes; ``Encoder.of(path)`` is kept per worker process."""

    _kept: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    @classmethod
    def rest(cls) -> None:
        """At the end of a task: drop the older pieces, since an idle worker lives on."""
        for kept in cls._kept.values():
            kept.older = {}

    @classmethod
    def release(cls) -> None:
        """Drop all that is kept, for an operator that goes on in a worker which has encoded before."""
        cls._kept.clear()

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        spelled = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        # Byte-level spellings of the blank and of the line end.
        self.leads = {sign: np.fromiter((t.startswith(mark) for t in spelled), bool, size) for sign, mark in ((" ", "\u0120"), ("\n", "\u010a"))}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_led(self, pieces: list[str], sign: str) -> list[bytes]:
        """Ids of visible pieces that a blank or a line end leads, encoded ``_RUN`` at a time."""
        texts = [sign + sign.join(pieces[a:a + _RUN]) for a in range(0, len(pieces), _RUN)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), "<u4")
        edges = (4 * np.append(np.flatnonzero(self.leads[sign][ids]), len(ids))).tolist()
        if len(edges) != len(pieces) + 1:
            return self._encode([sign + p for p in pieces])
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(edges, edges[1:])]

    def _fill(self, pieces: list[str]) -> None:
        """Put missing pieces into the cache; punctuation behind a letter is encoded apart."""
        words, older, parts, cores = self.words, self.older, [], set()
        for piece in pieces:
            if (known := older.get(piece)) is not None:
                words[piece] = known
                continue
            core = piece.rstrip(_PUNCTUATION)
            if core == piece or not core[-1:].isalpha():
                core = piece
            parts.append((piece, core))
            if core not in words:
                if (known := older.get(core)) is not None:
                    words[core] = known
                else:
                    cores.add(core)
        lone = [c for c in cores if c in ("", "\n")]
        words.update(zip(lone, self._encode([c or " " for c in lone])))
        inner = [c for c in cores if c and c[0] != "\n"]
        led = [c for c in cores if len(c) > 1 and c[0] == "\n"]
        for a in range(0, len(inner), _TURN):
            words.update(zip(inner[a:a + _TURN], self._encode_led(inner[a:a + _TURN], " ")))
        for a in range(0, len(led), _TURN):
            words.update(zip(led[a:a + _TURN], self._encode_led([c[1:] for c in led[a:a + _TURN]], "\n")))
        for piece, core in parts:
            if piece != core:
                end = piece[len(core):]
                if end not in self.ends:
                    if len(self.ends) > _CACHE_LIMIT // 10:
                        self.ends.clear()
                    self.ends[end] = self._encode([end])[0]
                words[piece] = words[core] + self.ends[end]

    def batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        split = [None if _OTHER_SPACE.search(t) else t.replace("\n", " \n").split(" ") for t in texts]
        if len(self.words) > _CACHE_LIMIT // 2:
            self.older, self.words = self.words, {}
        words = self.words
        self._fill([w for w in set(chain.from_iterable(s[1:] for s in split if s)) if w not in words])
        heads = iter(self._encode([s[0] if s else t for s, t in zip(split, texts)]))
        return [next(heads) if not s else next(heads) + b"".join(map(words.__getitem__, s[1:])) for s in split]
