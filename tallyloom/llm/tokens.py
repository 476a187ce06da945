"""Token ids of whole texts by a byte-level BPE of the tokenizers library, with a bounded memory of pieces.

Byte-level BPE never merges across its pre-tokens. So a text may be cut where a pre-token surely
starts, each distinct piece encoded once by the library, and the ids joined: the result is what the
library gives for the whole text. A text goes to the library whole if it holds a special token, or if
the vocabulary cuts pre-tokens by another rule.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa

from tallyloom.llm import bytewords

#: Pieces held with their ids in a worker; beyond that, new ones are encoded each time.
PIECES = 1_300_000
#: Longer pieces (bytes) are encoded each time.
LONGEST = 64
#: Bytes of texts whose pieces are looked up together.
STEP = 16 << 20

_byte = np.arange(256)
_letter = ((_byte | 32) >= 97) & ((_byte | 32) <= 122)
#: ASCII that is neither a letter nor white space nor a control.
_mark = (_byte > 32) & (_byte < 127) & ~_letter
#: First bytes of characters that aren't white space, whatever bytes follow (U+0085, 00A0, 1680, 2000 and on, 3000 begin with the others).
_solid = _mark | _letter | ((_byte >= 0xC3) & ~np.isin(_byte, (0xE1, 0xE2, 0xE3)))
#: Bits of a byte's kind. BEFORE: an apostrophe may belong to the letters after it, so it is none.
LETTER, MARK, SOLID, OTHER, BEFORE = 1, 2, 4, 8, 16
_KINDS = (_letter * LETTER + _mark * MARK + _solid * SOLID + ((_byte < 128) & ~_letter) * OTHER + (_mark & (_byte != ord("'"))) * BEFORE).astype(np.uint8).tobytes()


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a pre-token surely starts at each byte of texts that lie end to end, and none of the text before depends on what follows.

    That is so at the start of a text; at a space before another character; after a letter, at ASCII
    that isn't one; at a letter after a digit, a mark or a line feed, if the latter follows no white space.
    """
    kind = np.frombuffer(data.tobytes().translate(_KINDS), np.uint8).copy()
    # À to ÿ are 0xC3 and one more byte; all are letters but × and ÷.
    latin = np.flatnonzero(data[:-1] == 0xC3)
    latin = latin[(data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7)]
    kind[latin] |= LETTER
    kind[latin + 1] |= LETTER
    line = np.flatnonzero(data[1:] == 10)
    kind[line[kind[line] & (LETTER | MARK) > 0] + 1] |= BEFORE
    letter = kind & LETTER > 0
    begin, end = starts[:-1], starts[1:]
    held = end > begin
    out = data == 32
    out[:-1] &= kind[1:] & SOLID > 0
    out[end[held] - 1] = False  # the next byte is another text's
    out[1:] |= letter[:-1] & (kind[1:] & OTHER > 0)
    out[1:] |= letter[1:] & (kind[:-1] & BEFORE > 0)
    out[begin[held]] = True
    return out


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """flat(texts) -> how many ids each text has, and the ids of all, end to end; encode(texts) -> one uint32 array of ids for each."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        rule = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        #: Whether what cuts() says holds for this vocabulary.
        self.cut = self.tokenizer.normalizer is None and rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule["add_prefix_space"]
        #: Tokens that begin with a space, which byte-level vocabularies write as U+0120.
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.spaced[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
        #: Pieces that may follow any other, and of which only the first token begins with a space.
        self.follows = re.compile(rb" [!-~\xC3-\xE0\xE4-\xF4][^ ]*").fullmatch if self.cut else lambda piece: None
        self.known: dict[bytes, int] = {}  # piece -> its number
        self.ids = np.zeros(0, np.uint32)  # of all known pieces, by number
        self.at = np.zeros(1, np.int64)  # where the ids of each start, and the end

    def _each(self, pieces: list[bytes]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]

    def _row(self, pieces: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Sizes and ids of pieces that follow each other: encoded as one text, cut where a token begins with a space."""
        row = b"".join(pieces)
        if not any(s in row for s in self.special):
            (ids,) = self._each([row])
            at = np.flatnonzero(self.spaced[ids])
            return np.diff(at, append=len(ids)), [ids]
        parts = self._each(pieces)
        return np.array([len(x) for x in parts]), parts

    def _learn(self, new: list[bytes]) -> tuple[list[bytes], int, np.ndarray, np.ndarray]:
        """new in another order; how many of these, from the first, may be held; ids and their places, known pieces included."""
        rows, others, long = [], [], []
        for p in new:
            (long if len(p) > LONGEST else rows if self.follows(p) else others).append(p)
        sizes, ids = [], [self.ids]
        for i in range(0, len(rows), 4096):
            n, parts = self._row(rows[i : i + 4096])
            sizes.append(n)
            ids += parts
        # Long ones, which can be whole texts, one at a time.
        for part in (*(others[i : i + 4096] for i in range(0, len(others), 4096)), *([p] for p in long)):
            parts = self._each(part)
            sizes.append(np.array([len(x) for x in parts]))
            ids += parts
        at = np.concatenate((self.at, self.at[-1] + np.cumsum(np.concatenate(sizes))))
        return rows + others + long, len(new) - len(long), np.concatenate(ids), at

    def _flat(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins = starts[:-1][starts[1:] > starts[:-1]]
        if self.cut:
            cut = cuts(data, starts)
            raw = data.tobytes() if self.special else b""
            if any(s in raw for s in self.special):
                for a, b in zip(starts.tolist(), starts[1:].tolist()):
                    cut[a + 1 : b] &= not any(raw.find(s, a, b) >= 0 for s in self.special)
            place = np.flatnonzero(cut)
        else:
            place = begins
        pieces = pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer(np.append(place, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int32, len(distinct))
        missing = np.flatnonzero(number < 0)
        ids, at = self.ids, self.at
        if len(missing):
            base = len(at) - 1
            order, held, ids, at = self._learn([distinct[i] for i in missing.tolist()])
            now = dict(zip(order, range(base, base + len(order))))
            number[missing] = [now[distinct[i]] for i in missing.tolist()]
            if len(self.known) < PIECES:
                self.known.update(zip(order[:held], range(base, base + held)))
                self.at = at[: base + held + 1]
                self.ids = ids[: self.at[-1]]
                if held < len(order):  # else long ones would stay, too
                    self.at, self.ids = self.at.copy(), self.ids.copy()
        low, size = (x[pieces.indices.to_numpy()] for x in (at[number], at[number + 1] - at[number]))
        ends = np.concatenate(([0], np.cumsum(size)))
        out = ids[np.repeat((low - ends[:-1]).astype(np.int32), size) + np.arange(ends[-1], dtype=np.int32)]
        return np.diff(ends[np.searchsorted(place, starts)]), out

    def flat(self, texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        data, starts = bytewords.texts_of(texts)
        if not len(data):
            return np.zeros(len(texts), np.int64), np.zeros(0, np.uint32)
        parts = [self._flat(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a]) for a, b in bytewords.steps(data, starts, STEP)]
        return np.concatenate([n for n, _ in parts]), np.concatenate([x for _, x in parts])

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        counts, ids = self.flat(pa.array(texts, pa.large_string()))
        ends = np.cumsum(counts).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]


def grouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to about `rows` rows: a piece that is not known is encoded once for each group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            held.append(batch.slice(i, rows))
            if sum(b.num_rows for b in held) >= rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each vocabulary in a worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
