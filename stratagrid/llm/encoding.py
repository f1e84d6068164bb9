"""Token ids of whole texts by a public byte-level tokenizer, with a bounded memo of chunks.

A byte-level BPE pre-tokenizer never joins a blank to the character before it, unless that is white
space too. A text may therefore be cut before each blank that follows something else, and the ids of
the text are the ids of the chunks one after another. Chunks repeat, so most come from the memo; the
tokenizers library encodes the rest. A text that holds the string of a special token goes to the
library whole.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right
from functools import lru_cache
from itertools import repeat

import numpy as np

#: Cut before a blank that follows no white space (the white space of Unicode, as str.isspace has it).
_CUT = re.compile(r"(?<=\S) ")
#: How a byte-level vocabulary writes the blank.
BLANK = "\u0120"
#: Signs that are neither letters, digits nor white space.
_SIGNS = ".,;:!?|#*$%&<>()"
_ASIDE = re.compile("[\x1c-\x1f]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ChunkEncoder:
    """Encodes texts to bytes of little-endian unsigned 32-bit ids.

    memo_entries bounds the memo: at that size the older half of it is forgotten, which costs time only.
    """

    def __init__(self, path: str, memo_entries: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.starts = np.zeros(max(self.tokenizer.get_vocab(True).values()) + 1, dtype=bool)
        self.starts[[i for token, i in self.tokenizer.get_vocab(True).items() if token[0] == BLANK]] = True
        self.half = memo_entries // 2
        self.memo: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}
        self.odd: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]

    def _learn(self, pieces: set[str]) -> None:
        """Ids of pieces as they are after a blank; None for those after which no cut is sound.

        Signs at the end of a letter or digit are a token run of their own, so "word." is "word" and "."."""
        cut, todo = [], set()
        for p in pieces:
            if (ids := self.old.get(p, self)) is not self:
                self.memo[p] = ids
            elif not p or p[-1].isspace():
                self.memo[p] = None
            elif (core := p.rstrip(_SIGNS)) != p and core and core[-1].isalnum():
                cut.append((p, core, p[len(core) :]))
                if core not in self.memo:
                    if core in self.old:
                        self.memo[core] = self.old[core]
                    else:
                        todo.add(core)
            else:
                todo.add(p)
        # many pieces in one text: a token that starts with a blank starts the next piece
        words = list(todo)
        groups = [words[i : i + 400] for i in range(0, len(words), 400)]
        for group, raw in zip(groups, self._whole([f" {' '.join(g)}" for g in groups])):
            at = np.flatnonzero(self.starts[np.frombuffer(raw, dtype="<u4")])
            if len(at) == len(group) and at[0] == 0:
                cuts = [*(at * 4).tolist(), len(raw)]
                self.memo.update(zip(group, [raw[s:e] for s, e in zip(cuts, cuts[1:])]))
            else:
                self.memo.update(zip(group, self._whole([f" {p}" for p in group])))
        for p, core, tail in cut:
            self.memo[p] = self.memo[core] + self._odd_chunk(tail)

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if any(s in t for s in self.special) or _ASIDE.search(t)]
        apart = set(whole)
        head, flat, ends = [], [], []
        for i, t in enumerate(texts):
            first, *pieces = ("",) if i in apart else t.split(" ")
            head.append(first)
            flat += pieces
            ends.append(len(flat))
        if len(self.memo) > self.half:
            self.old, self.memo = self.memo, {}
        ids = list(map(self.memo.get, flat, repeat(self)))
        if missing := [k for k, x in enumerate(ids) if x is self]:
            self._learn({flat[k] for k in missing})
            for k in missing:
                ids[k] = self.memo[flat[k]]
        odd = {bisect_right(ends, k) for k, x in enumerate(ids) if x is None}
        out: list[bytes] = [b""] * len(texts)
        for i, (first, a, b) in enumerate(zip(head, [0, *ends], ends)):
            if i in odd or b > a and (not first or first[-1].isspace()):
                head[i], *more = _CUT.split(texts[i])
                out[i] = b"".join(self._odd_chunk(" " + c) for c in more)
            else:
                out[i] = b"".join(ids[a:b])
        for i, found in enumerate(self._whole(head)):
            out[i] = found + out[i]
        for i, found in zip(whole, self._whole([texts[i] for i in whole])):
            out[i] = found
        return out

    def _odd_chunk(self, chunk: str) -> bytes:
        if (ids := self.odd.get(chunk)) is None:
            if len(self.odd) > self.half // 4:
                self.odd.clear()
            ids = self.odd[chunk] = self._whole([chunk])[0]
        return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process; it stays between tasks."""
    return ChunkEncoder(path)
